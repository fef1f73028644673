"""Schemas of the tables and of the payloads they come from, in DDL."""

SPEECHES = (
    "speech_id long, date string, time string, source_file string, source_url string, speaker string,"
    " speaker_role string, speaker_faction string, text string, text_lemmas string"
)
#: Lines of the yearly speech files; the first five and the text are mandatory.
SPEECH_LINES = (
    "date string, time string, source_file string, source_url string, speaker string,"
    " speaker_role string, speaker_faction string, text string, text_lemmas string"
)
MANDATORY = ("date", "time", "source_file", "source_url", "speaker", "text")
REJECTED = "reason string, file string, record string"
LEMMAS = "speech_id long, text_lemmas string"
POSTINGS = "speech_id long, lemma string, count long"
ATTENDANCE = "session_date string, voting_uuid string, member_name string, faction string, status string"
FACTION_HISTORY = "name string, faction string, start string, end string, place int"

VERBATIMS = (
    "link string, title string, date string, agendaItems array<struct<events: array<struct<type: string, text: string, speaker: string>>>>"
)
VOTINGS = "votings array<struct<uuid: string, startDateTime: string, type: struct<code: string>>>"
VOTERS = (
    "uuid string, startDateTime string, voters array<struct<fullName: string, faction: struct<name: string>, decision: struct<code: string>>>"
)
MEMBERS = (
    "firstName string, lastName string, factions array<struct<name: string, membership: struct<startDate: string, endDate: string>>>"
)

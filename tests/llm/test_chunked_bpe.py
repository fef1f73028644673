"""BPE over shared chunks against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tribune.llm import chunked_bpe, queries

MODEL = chunked_bpe.read_model(queries.WORD_BPE)
LIBRARY = Tokenizer.from_str(MODEL)
SCHEMA = "doc_id long, text string, key int, digests string"


def wanted(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(text, of):
    """A text by its chunks, each encoded by itself, and joined."""
    sections = of.sections(text)
    parts = [(s, "", str(c), "") if isinstance(c, int) else (s, *chunked_bpe.split(c, of.ids)) for s, _, c in chunked_bpe.chunks_of([sections])[0]]
    return chunked_bpe.joined(parts, of)


@pytest.fixture(scope="module")
def of():
    return chunked_bpe.Codec(MODEL)


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["The", "don't", "we'll've", "it's", "Straße", "ΣΑΣ", "İstanbul", "naïve", "été", "123", "4½", "…", "--", "'", "''s", "你好", "한국어", "🙂🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "ǅ", "Ƛ", "՘x", "http://x.y/z?q=1", "antidisestablishmentarianism"]
    gaps = [" ", " ", " ", "", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "​"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([1, 5, 50, 800]))) for _ in range(n)]


def test_every_character(of):
    odd = []
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and not chunked_bpe._ODD.search(chr(c)):
            s = f"a{chr(c)}B1 {chr(c)}'s"
            if of.normalised(s) != LIBRARY.normalizer.normalize_str(s):
                odd.append(c)
            elif of.words.findall(of.normalised(s)) != [of.normalised(s)[b:e] for _, (b, e) in LIBRARY.pre_tokenizer.pre_tokenize_str(of.normalised(s))]:
                odd.append(c)
    assert not odd, [hex(c) for c in odd[:30]]


def test_words(of):
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 127, 128, 129, 130, 500, 5000):
        for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éèêabc"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert of.word(word.encode()) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_words_side_by_side(of):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß'1") for _ in range(rng.randrange(1, 16))).encode() for _ in range(3000)] + [b"a", b"ab", b"a" * 32]
    assert of.side_by_side(words) == [" ".join(map(str, of.word(w))) for w in words] and of.side_by_side([]) == []


def test_learning_ahead(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "PIECES_HELD", 50)
    own = chunked_bpe.Codec(MODEL)
    for k in range(4):
        some = [own.normalised(t) for t in texts(6, k)]
        own.learn(some)
        for t in some:
            assert own.ids(t) == " ".join(map(str, LIBRARY.encode(t, add_special_tokens=False).ids)) or "<|" in t


def test_chunks_join_exactly(of, monkeypatch):
    for usual in (4, 64, 1024):
        monkeypatch.setattr(chunked_bpe, "USUAL", usual)
        monkeypatch.setattr(chunked_bpe, "LEAST", usual // 4)
        monkeypatch.setattr(chunked_bpe, "MOST", usual * 8)
        for text in texts(60, usual) + ["", " ", "'", "x" * 3000, "don" * 40 + "'t" * 40, "あ" * 500, " a" * 900]:
            assert own(text, of) == " ".join(map(str, wanted(text)[0]))


def test_cuts_follow_the_content():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij klm") for _ in range(20_000))
    a, b = chunked_bpe.chunks_of([["x" * 777 + passage], [passage + "tail"]])
    shared = {c for _, _, c in a} & {c for _, _, c in b}
    assert sum(map(len, shared)) > 15_000
    assert all(len(c) <= chunked_bpe.MOST for _, _, c in a) and "".join(c for _, _, c in a) == "x" * 777 + passage


def test_documents(spark):
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh'é") for _ in range(rng.randrange(1, 9))) for _ in range(1500))
    rows = [(i, t) for i, t in enumerate(texts(40, 9))]
    rows += [(100 + i, f"start {i} {passage} end {i}") for i in range(12)] + [(200 + i, passage) for i in range(30)] + [(300, passage[:5000]), (300, passage[100:]), (None, passage[3:]), (301, "x" + passage + "<|endoftext|>" + passage)]
    rows += [(400, None), (401, ""), (402, " "), (402, " "), (403, "w" * 60_000), (404, (passage + " ") * 30)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = chunked_bpe.encode(df, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = [(i, *wanted(t)) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=order) == sorted(want, key=order)
    assert all(r.n_tokens == len(r.ids) for r in got.collect())
    told = chunked_bpe.encode(df, MODEL, digests=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in told) == sorted((sha(" ".join(map(str, ids))), sha(text)) for _, ids, text in want)
    back = chunked_bpe.decode(got.drop("decoded"), MODEL).select("decoded").collect()
    assert sorted(r.decoded for r in back) == sorted(w[2] for w in want)


def test_empty_table(spark):
    assert chunked_bpe.encode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    seen = []
    real = chunked_bpe.cut
    monkeypatch.setattr(chunked_bpe, "cut", lambda df, what: seen.append((what, real(df, what))) or seen[-1][1])
    monkeypatch.setattr(chunked_bpe, "drop_scratch", lambda *tables: None)
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    df = spark.createDataFrame([(i, f"{i} {passage} {i}", 1, "x") for i in range(20)], SCHEMA).repartition(4)
    assert chunked_bpe.encode(df, MODEL, digests=True).count() == 20
    coded = dict(seen)["coded"]
    lent = [r.digest for r in coded.where("digest is not null").collect()]
    assert len(lent) == len(set(lent)) > 10
    own_ids = coded.where("parts is not null").selectExpr("explode(parts) as p").where("p.digest is null").selectExpr("sum(length(p.ids)) as n").first().n
    assert coded.where("parts is not null").count() == 19 and own_ids < 19 * 4000  # what borrowers encode themselves is their first and last chunk


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="supported"):
        chunked_bpe.Codec(chunked_bpe.read_model("/opt/tokenizers/byte_bpe_50k.json"))

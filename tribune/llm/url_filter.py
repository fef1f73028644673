"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Rules are strings host/path with a verdict. A rule fits its host and all subdomains of it if the url's path
starts with the rule's path; of the rules that fit, the longest wins. Pages that no rule fits are judged by their host:
trust is personalised PageRank over host links from the trusted hosts (those on which an allow rule lies), distrust is
the same over reversed links from the blocked hosts (those that a block rule covers whole), so a host that links to
blocked ones is distrusted, and one that trusted ones link to is trusted. A host is blocked when its distrust
exceeds its trust and is at least `threshold` times what an even share would be; without evidence it is allowed.

Both ranks are computed in one loop over one table of hosts, until the distance to the exact scores is proven to be below a
hundredth of an even share; without links there is no loop. Everything is joins and aggregations on hosts. Host tables are broadcast only below a counted size; a host with a third of all pages or
links costs one row per task in each partial aggregation, and its joins are split by adaptive execution. A url without a path, such as http://a.net,
has an empty path, with which no rule's path begins; its host is a blocked one all the same, so the method blocks it.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Defined cases: a null url,
or one without ://, has an empty host and path, fits no rule and is allowed; null html has no links; links to
the same host do not count and repeated links count once; rows that repeat a page are judged each; other columns
are kept unless they bear the names of results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch

#: Rules of the production query, in order of the contract.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING = 0.85
#: Rounds end when all scores together are proven to be within this part of an even share of the exact ones (floating numbers end at FINEST).
ERROR, FINEST = 0.01, 1e-13
THRESHOLD = 1.0
#: Up to so many hosts (some 200 bytes each) are broadcast; beyond, a shuffle joins them.
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s<>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = F.coalesce(F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(part, _UPPER, _LOWER), path


def _suffixes(host: Column, labels: int) -> Column:
    """The last one to `labels` labels of a host (all that a rule can name), so that a long host costs no more than its length."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    return F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.lit(labels)), "."))


def _rule_table(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    rows = [(r.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER)), "/" + r.partition("/")[2], r, v) for r, v in rules]
    return df.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of absolute links in html between different hosts. pages: host, html."""
    found = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("to"))
    return found.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst").distinct()


def spread(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """Personalised PageRank over links from the hosts marked trusted, and over reversed links from those marked blocked: (host, trust,
    distrust). Either sums to 1 over hosts if any host is so marked; else all are 0. Mass at hosts without links returns to the marked ones.

    hosts: host, trusted, blocked.
    """
    n, n_trusted, n_blocked = hosts.agg(F.count("*"), F.count_if("trusted"), F.count_if("blocked")).first()
    share = lambda mark, k: F.when(F.col(mark), 1.0 / max(k, 1)).otherwise(0.0)
    start = hosts.select("host", share("trusted", n_trusted).alias("base_t"), share("blocked", n_blocked).alias("base_d"))
    n_links = links.count()
    if not n_links or not (n_trusted or n_blocked):
        return start.select("host", F.col("base_t").alias("trust"), F.col("base_d").alias("distrust"))
    out = links.groupBy("src").agg(F.count("*").alias("n_out"))
    into = links.groupBy("dst").agg(F.count("*").alias("n_in"))
    # a link carries trust forwards and distrust backwards
    carried = cut(links.join(out, "src").join(into, "dst").select(F.explode(F.array(
        F.struct(F.col("src").alias("giver"), F.col("dst").alias("taker"), (1 / F.col("n_out")).alias("part_t"), F.lit(0.0).alias("part_d")),
        F.struct(F.col("dst").alias("giver"), F.col("src").alias("taker"), F.lit(0.0).alias("part_t"), (1 / F.col("n_in")).alias("part_d")),
    )).alias("c")).select("c.*").groupBy("giver", "taker").agg(F.sum("part_t").alias("part_t"), F.sum("part_d").alias("part_d")), "carried")
    gives = carried.groupBy("giver").agg((F.sum("part_t") > 0.5).alias("gives_t"), (F.sum("part_d") > 0.5).alias("gives_d"))
    start = start.join(gives, F.col("host") == F.col("giver"), "left").drop("giver").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gives_t", "gives_d")})
    now = cut(start.withColumns({"trust": F.col("base_t"), "distrust": F.col("base_d"), "moved": F.lit(2.0)}), "scores")
    while True:
        # what hosts with links hold is passed on, the rest returns; and the distance of the last two rounds
        kept_t, kept_d, moved = now.agg(F.sum(F.when(F.col("gives_t"), F.col("trust"))), F.sum(F.when(F.col("gives_d"), F.col("distrust"))), F.sum("moved")).first()
        if moved * DAMPING / (1 - DAMPING) <= max(ERROR / n, FINEST):
            drop_scratch(carried)
            return now.select("host", "trust", "distrust")
        flow = carried.join(now.select(F.col("host").alias("giver"), "trust", "distrust"), "giver").groupBy("taker")
        flow = flow.agg(F.sum(F.col("trust") * F.col("part_t")).alias("got_t"), F.sum(F.col("distrust") * F.col("part_d")).alias("got_d"))
        score = lambda base, kept, got: F.col(base) * (1 - DAMPING * (kept or 0.0)) + DAMPING * F.coalesce(got, F.lit(0.0))
        then = now.join(flow, F.col("host") == F.col("taker"), "left").withColumns({"new_t": score("base_t", kept_t, "got_t"), "new_d": score("base_d", kept_d, "got_d")})
        moved = F.abs(F.col("new_t") - F.col("trust")) + F.abs(F.col("new_d") - F.col("distrust"))
        then = cut(then.select("host", "base_t", "base_d", "gives_t", "gives_d", F.col("new_t").alias("trust"), F.col("new_d").alias("distrust"), moved.alias("moved")), "scores")
        drop_scratch(now)
        now = then


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule, verdict, trust, distrust."""
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    host, path = host_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    links = cut(host_links(pages.select("host", "html")), "links")
    own = pages.select("host").where("host <> ''").distinct()
    names = own.union(links.select("src")).union(links.select("dst")).distinct()
    table = _rule_table(pages, rules)  # as long as the list of rules in the program
    labels = max((r.partition("/")[0].count(".") + 1 for r, _ in rules), default=1)
    fits = names.select("host", F.explode(_suffixes(F.col("host"), labels)).alias("rule_host")).join(F.broadcast(table), "rule_host")
    per_host = fits.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("long"), "rule", "rule_path", "verdict")), asc=False).alias("rules"))
    hosts = names.join(per_host, "host", "left")
    rule_is = lambda test: F.coalesce(F.exists("rules", test), F.lit(False))
    hosts = cut(hosts.withColumns({"trusted": rule_is(lambda r: r["verdict"] == "allow"), "blocked": rule_is(lambda r: (r["verdict"] == "block") & (r["rule_path"] == "/"))}), "hosts")
    n = hosts.count()
    doubt = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.lit(float(n)) >= threshold)
    judged = hosts.join(spread(hosts.select("host", "trusted", "blocked"), links), "host")
    own = {"_url_host": F.col("host"), "_url_rules": F.col("rules"), "_url_trust": F.col("trust"), "_url_distrust": F.col("distrust"), "_url_by_host": F.when(doubt, "block").otherwise("allow")}
    judged = cut(judged.select(*(c.alias(name) for name, c in own.items())), "judged")
    judged = F.broadcast(judged) if n <= BROADCAST_HOSTS else judged
    first = F.get(F.filter("_url_rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    verdict = {"rule": F.col("_url_rule.rule"), "verdict": F.coalesce("_url_rule.verdict", "_url_by_host", F.lit("allow")), "trust": F.coalesce("_url_trust", F.lit(0.0)), "distrust": F.coalesce("_url_distrust", F.lit(0.0))}
    return pages.join(judged, F.col("host") == F.col("_url_host"), "left").withColumn("_url_rule", first).withColumns(verdict).drop("_url_rule", *own)

"""URL filtering by path-template trees, in DataFrame functions only.

Listed rules judge what they fit. They also label pages, and from these labels a tree of path
templates is learnt for each host. A segment stays literal where it has a share of the pages at
its place of the host, or enough labelled pages of its own; any other becomes a wildcard with its
extension. Level by level, sibling branches are ordered by their share of blocked pages, and
neighbours whose shares a two-proportion z test cannot tell apart are merged, transitively; a
merged branch's subtrees are joined, so that the next level counts over all its members. A page
that no rule fits is judged by the deepest branch on its path, by the smoothed share of blocked
pages among the branch's labelled ones, and by its host's share where no branch has enough. A
host's share is smoothed by that of all labelled pages.

Pages are parsed once, and counted by host, place and segment, and by host and template, before
anything is compared. A level's work is on templates, not on pages; levels end where no branch
has labelled pages enough, as no deeper one has more. Joins back to pages are salted
on the pages' side, so that a host with a third of all pages is dealt to many tasks.

Defined cases: a null url, or one without ``://``, has an empty host and path, and pages without
a host are judged together; rules need not fit any page (then all unfit pages are allowed);
siblings with equal shares are ordered by their names; repeated rows each get a row; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versicle.llm.common import cut

#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A segment stays literal from so many pages and this share of the pages at its place, or from so many labelled pages.
LITERAL_PAGES, LITERAL_SHARE, LITERAL_LABELLED = 5, 0.02, 30
#: Pseudo-pages of the host's (or the global) share, and labelled pages that a branch needs.
SMOOTHING, BRANCH_PAGES = 4.0, 3
Z, REJECT = 1.96, 0.6
#: Parts that a host's pages are dealt to in joins with what was learnt of it.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    found = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def _ratio(blocked: Column, pages: Column, prior: Column) -> Column:
    return (blocked + SMOOTHING * prior) / (pages + SMOOTHING)


def _salted(small: DataFrame) -> DataFrame:
    """A copy of each row for each part of the pages."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (with ``host``, ``path`` and ``verdict``) and ``template``, its generalised segments."""
    names = pages.columns
    split = cut(pages.withColumns({"segments": F.filter(F.split("path", "/"), lambda s: s != ""), "__row": F.monotonically_increasing_id()}))
    places = split.select("__row", "host", "verdict", F.posexplode("segments").alias("place", "segment"))
    counts = places.groupBy("host", "place", "segment").agg(F.count("*").alias("n"), F.count("verdict").alias("ln"))
    totals = counts.groupBy("host", "place").agg(F.sum("n").alias("total"))
    common = (F.col("n") >= LITERAL_PAGES) & (F.col("n") >= LITERAL_SHARE * F.col("total"))
    literals = counts.join(totals, ["host", "place"]).where(common | (F.col("ln") >= LITERAL_LABELLED)).select("host", "place", "segment", F.lit(True).alias("literal"))
    placed = places.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(_salted(literals), ["host", "place", "segment", "salt"], "left")
    general = F.when(F.col("literal"), F.col("segment")).otherwise(F.concat(F.lit("*"), F.regexp_extract("segment", r"\.[A-Za-z]{1,5}$", 0)))
    made = placed.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("place", general.alias("part")))).alias("parts"))
    joined = split.join(made, "__row", "left").withColumn("template", F.coalesce(F.array_join(F.transform("parts", lambda p: p["part"]), "/"), F.lit("")))
    return joined.select(*names, "template")


def template_verdicts(pages: DataFrame) -> DataFrame:
    """``host, template, learnt``: the verdict for every template of pages that have ``host, template, verdict``."""
    counted = cut(pages.groupBy("host", "template").agg(F.count("verdict").alias("n"), F.count_if(F.col("verdict") == "block").alias("b")))
    total = counted.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall"))
    hosts = counted.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb")).crossJoin(F.broadcast(total))  # one row
    hosts = hosts.select("host", _ratio(F.col("hb"), F.col("hn"), F.col("overall")).alias("share"))
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    state = cut(counted.join(hosts, "host").select("host", "template", "n", "b", "share", parts.alias("parts"), F.lit("").alias("branch"), F.lit(None).cast("double").alias("purity"), F.lit(True).alias("open")))
    depth = 0
    while True:
        depth += 1
        merged = cut(merged_siblings(state, depth))
        if merged.isEmpty():
            break
        state = cut(
            state.withColumn("part", F.get("parts", F.lit(depth - 1)))
            .join(merged, ["host", "branch", "part"], "left")
            .select("host", "template", "n", "b", "share", "parts", F.coalesce("to", "branch").alias("branch"), F.coalesce("found", "purity").alias("purity"), (F.col("open") & F.col("to").isNotNull()).alias("open"))
        )
    return state.select("host", "template", F.when(F.coalesce("purity", "share") >= REJECT, "block").otherwise("allow").alias("learnt"))


def merged_siblings(state: DataFrame, depth: int) -> DataFrame:
    """``host, branch, part, to, found``: the merged branch of each child with labelled pages enough, and its purity.

    ``state`` has ``host, branch, open, parts, n, b, share``: templates on the branches that reach this depth.
    """
    nodes = state.where(F.col("open") & (F.size("parts") >= depth)).groupBy("host", "branch", F.get("parts", F.lit(depth - 1)).alias("part"))
    nodes = nodes.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("share").alias("share")).where(F.col("n") >= BRANCH_PAGES)
    order = Window.partitionBy("host", "branch").orderBy(F.col("b") / F.col("n"), "part")
    before = {c: F.lag(c).over(order) for c in ("n", "b")}
    nodes = nodes.withColumns({"n0": before["n"], "b0": before["b"]})
    pooled = (F.col("b") + F.col("b0")) / (F.col("n") + F.col("n0"))
    z = (F.col("b") / F.col("n") - F.col("b0") / F.col("n0")) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("n0")) + 1e-12)
    nodes = nodes.withColumn("run", F.sum(F.when(z > Z, 1).otherwise(0)).over(order))
    runs = nodes.groupBy("host", "branch", "run").agg(F.sum("n").alias("rn"), F.sum("b").alias("rb"), F.min("part").alias("name"), F.first("share").alias("prior"))
    found = nodes.select("host", "branch", "run", "part").join(runs, ["host", "branch", "run"])
    return found.select("host", "branch", "part", F.concat_ws("/", "branch", "name").alias("to"), _ratio(F.col("rb"), F.col("rn"), F.col("prior")).alias("found"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row; ``template`` and ``learnt`` follow."""
    host, path = host_and_path(F.col(url_col))
    parsed = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = cut(templates(parsed.withColumns({"rule": rule, "verdict": verdict})))
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(_salted(template_verdicts(pages)), ["host", "template", "salt"])
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "learnt").alias("verdict"), "template", "learnt")


#: The same in SQL, for ``page_id, host, path, rule, verdict``, down to this many levels.
SQL_LEVELS = 8
_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed
), labelled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM ruled
), places AS (
  SELECT page_id, host, said, segments[p] AS segment, p - 1 AS place FROM (SELECT page_id, host, said, segments, unnest(range(1, len(segments) + 1)) AS p FROM labelled)
), counts AS (SELECT host, place, segment, count(*) AS n, count(said) AS ln FROM places GROUP BY ALL
), frequent AS (
  SELECT host, place, segment FROM (SELECT *, sum(n) OVER (PARTITION BY host, place) AS total FROM counts) WHERE (n >= 5 AND n >= 0.02::DOUBLE * total) OR ln >= 30
), literals AS (SELECT host, list(place || '/' || segment) AS known FROM frequent GROUP BY host
), pages2 AS (
  SELECT l.*, list_transform(segments, lambda s, i: CASE WHEN list_contains(coalesce(known, []), (i - 1) || '/' || s) THEN s
              ELSE '*' || regexp_extract(s, '\.[A-Za-z]{1,5}$', 0) END) AS t FROM labelled l LEFT JOIN literals USING (host)
), counted AS (SELECT host, t, count(said) AS n, count(*) FILTER (said = 'block') AS b FROM pages2 GROUP BY host, t
), hosts AS (
  SELECT host, (sum(b) + 4.0::DOUBLE * (SELECT (coalesce(sum(b), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) FROM counted)) / (sum(n) + 4.0::DOUBLE) AS share FROM counted GROUP BY host
), level0 AS (SELECT host, t, n::DOUBLE AS n, b::DOUBLE AS b, share, '' AS branch, NULL::DOUBLE AS purity, true AS open FROM counted JOIN hosts USING (host)
)"""
_SQL_LEVEL = """, node{d} AS (
  SELECT host, branch, t[{d}] AS part, sum(n) AS n, sum(b) AS b, any_value(share) AS share FROM level{e} WHERE open AND len(t) >= {d} GROUP BY ALL HAVING sum(n) >= 3
), pair{d} AS (
  SELECT *, lag(n) OVER w AS n0, lag(b) OVER w AS b0 FROM node{d} WINDOW w AS (PARTITION BY host, branch ORDER BY b / n, part)
), run{d} AS (
  SELECT *, sum(CASE WHEN (b / n - b0 / n0) / sqrt((b + b0) / (n + n0) * (1 - (b + b0) / (n + n0)) * (1 / n + 1 / n0) + 1e-12) > 1.96 THEN 1 ELSE 0 END) OVER (PARTITION BY host, branch ORDER BY b / n, part) AS run FROM pair{d}
), merged{d} AS (
  SELECT host, branch, part, branch || '/' || min(part) OVER r AS into_, (sum(b) OVER r + 4.0::DOUBLE * share) / (sum(n) OVER r + 4.0::DOUBLE) AS found FROM run{d} WINDOW r AS (PARTITION BY host, branch, run)
), level{d} AS (
  SELECT l.host, l.t, l.n, l.b, l.share, coalesce(m.into_, l.branch) AS branch, coalesce(m.found, l.purity) AS purity, l.open AND m.into_ IS NOT NULL AS open
  FROM level{e} l LEFT JOIN merged{d} m ON m.host = l.host AND m.branch = l.branch AND m.part = l.t[{d}]
)"""
SQL = _SQL + "".join(_SQL_LEVEL.format(d=d, e=d - 1) for d in range(1, SQL_LEVELS + 1)) + f"""
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN coalesce(purity, share) >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages2 p JOIN level{SQL_LEVELS} v ON v.host = p.host AND v.t = p.t
"""

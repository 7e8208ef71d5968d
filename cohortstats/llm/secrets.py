"""Secret scan by corpus-wide ownership frequency, in DataFrame and SQL functions only.

Candidates are found by pattern in every whole text. Their hashes are counted over the
corpus by distinct repositories and owners: a value that many owners hold is a widely
copied example, one that a single owner holds looks live. Beside the base kinds, long
tokens of mixed character classes are candidates that become spans only where their
ownership says that they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, checkpoint, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and what of a match is the secret. Runs shorter than these minima fail, so the
#: patterns of single runs carry their minimum; an assignment's is checked after it matched.
KINDS = (("assign", ASSIGN, 2), ("access", r"AKIA[A-Z0-9]{16,}", 0), ("hex", r"[0-9a-f]{24,}", 0))
ASSIGN_LEAST = 6
#: The method's own kind: long runs with a digit, a lower-case and an upper-case letter.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{24,}", 0)
MAX_OWNERS = 1

# two characters that no text should hold: one marks matches, the other stands for it if a text does
_MARK, _STAND_IN = "\ufdd0", "\ufdd1"
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
_NONE = f"cast(array() as {_SPAN})"
_PARTS = "array<struct<rank:int,i:int,n:int,value:string>>"
#: Characters of a block of text that redaction copies at a time.
_BLOCK = 1024


def _parts(text: Column, kind: int, pattern: str, group: int) -> Column:
    """What lies between and in the leftmost non-overlapping matches, in turn: number, length, and the secret of a match."""
    marked = F.regexp_replace(text, f"(?:{pattern})", f"{_MARK}$0{_MARK}")
    value = (lambda s: s) if not group else (lambda s: F.regexp_extract(s, pattern, group))
    one = lambda s, i: F.struct(F.lit(kind).alias("rank"), i.alias("i"), F.length(s).alias("n"), F.when(i % 2 == 1, value(s)).alias("value"))
    return F.when(text.rlike(pattern), F.transform(F.split(marked, _MARK, -1), one)).otherwise(F.expr(f"cast(array() as {_PARTS})"))


def candidates(docs: DataFrame, repository: str = "source", owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(__row, __key (a hash of the text), doc_id, repo, owner) of each row, none of the text, and the candidates:
    __row, repo, owner, start, rank, end and value of base spans and of ``owned`` ones apart from them.

    Both come from one checkpoint, so that __row names a row for good. The owner is what stands
    before the first slash of the repository unless a column is named. Positions are running sums
    over a row's matches, so a text's cost grows with its matches, not with their square.
    """
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(_MARK), F.lit(_STAND_IN))
    own = F.col(owner) if owner else F.substring_index(F.col(repository), "/", 1)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).alias("repo"), own.alias("owner"), F.xxhash64("text").alias("__key"), text.alias("__text"))
    parts = F.concat(*[_parts(F.col("__text"), k, p, g) for k, (_, p, g) in enumerate((*KINDS, OWNED))])
    found = checkpoint(rows.select("__row", "__key", "doc_id", "repo", "owner", parts.alias("parts")))
    each = found.where(F.size("parts") > 0).select("__row", "repo", "owner", F.explode("parts").alias("x")).select("__row", "repo", "owner", "x.*").repartition("__row")
    end = F.sum(F.col("n").cast("long")).over(Window.partitionBy("__row", "rank").orderBy("i"))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where(F.col("i") % 2 == 1)
    extra = F.col("rank") == len(KINDS)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    spans = spans.where(F.when(extra, mixed).when(F.col("rank") == 0, F.length("value") >= ASSIGN_LEAST).otherwise(True))
    # a base span overlaps what starts at or after it as far as the farthest end so far, and what starts before it from its start
    # (frames that end at a row are summed up as they grow; ones that begin there would be summed anew for each row)
    so_far = lambda order: Window.partitionBy("__row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    behind = F.max(F.when(~extra, F.col("end"))).over(so_far(F.col("start")))
    ahead = F.min(F.when(~extra, F.col("start"))).over(so_far(F.col("start").desc()))
    apart = ~(F.coalesce(behind > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))
    spans = spans.withColumn("__apart", ~extra | apart).where("__apart").select("__row", "repo", "owner", "start", "rank", "end", "value")
    return found.drop("parts"), checkpoint(spans)


def ownership(found: DataFrame) -> DataFrame:
    """Of each candidate's hash: distinct repositories, distinct owners and rows that hold it.

    Copies within one repository are summed before anything is shuffled by hash. Rows without an
    owner, or without a repository, are together one owner's, or one repository's.
    """
    one = found.select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.xxhash64("value").alias("hash"))
    per = one.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per = per.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return per.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_rows"))


def _judged(found: DataFrame, max_owners: int, max_repos: int | None) -> DataFrame:
    """The candidates and whether they look live: few enough owners, and repositories, hold their value."""
    many = F.col("n_owners") > max_owners
    if max_repos is not None:
        many |= F.col("n_repos") > max_repos
    copied = checkpoint(ownership(found).where(many).select(F.col("hash").alias("__hash")))
    known = found.withColumn("hash", F.xxhash64("value")).join(copied, F.col("hash") == F.col("__hash"), "left")
    return known.withColumn("live", F.col("__hash").isNull()).drop("hash", "__hash")


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int | None = None) -> DataFrame:
    """One row a document row: __key (a hash of the text), doc_id, base (base spans), spans (base and live ``owned`` ones)
    and live (the spans whose value at most ``max_owners`` owners, and ``max_repos`` repositories if given, hold); spans ascend by start.

    A null text has no spans. Rows without an owner are together one more owner's. Repeated rows
    count as rows, not as owners. A very long text is scanned whole; its spans gather in one row. An
    empty table gives an empty result. Offsets are code points. Only doc_id, text and the columns
    named are read, whatever other columns are called.
    """
    rows, found = candidates(docs, repository, owner)
    span = F.struct("start", "rank", "end", "value")
    extra = F.col("rank") == len(KINDS)
    take = lambda when: F.array_sort(F.collect_list(F.when(when, span)))
    by = _judged(found, max_owners, max_repos).groupBy("__row").agg(take(~extra).alias("base"), take(~extra | F.col("live")).alias("spans"), take(F.col("live")).alias("live")).withColumnRenamed("__row", "__of")
    joined = rows.join(by, F.col("__row") == F.col("__of"), "left")
    return joined.select("__key", "doc_id", *[F.coalesce(c, F.expr(_NONE)).alias(c) for c in ("base", "spans", "live")])


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k, _, _ in (*KINDS, OWNED)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, repository: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every live span of text replaced by ``mark`` (spans that overlap are one), and
    n_chars, if there is such a column, set to the new length. All rows and all other columns stay; rows
    without a candidate aren't moved. Rows of one id and text are redacted alike: what is live in any is replaced in all."""
    names = docs.columns
    has = F.coalesce(F.col("text").rlike("|".join(p for _, p, _ in (*KINDS, OWNED))), F.lit(False))
    rows, found = candidates(docs, repository)
    live = _judged(found, MAX_OWNERS, None).where("live").select("__row", "start", "end")
    # the text kept before each span that begins past all earlier ones, and where the last ends
    past = F.coalesce(F.max("end").over(Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = live.withColumn("a", past).groupBy("__row").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("a"), F.struct("a", F.col("start").alias("b"))))).alias("gaps"), F.max("end").alias("last"))
    gaps = gaps.withColumnRenamed("__row", "__of").join(rows, F.col("__of") == F.col("__row")).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"), "gaps", "last")
    # equal ids and texts have equal candidates, and equal values are live together: the rows left differ in nothing
    gaps = gaps.groupBy("__id", "__of").agg(F.min(F.struct("gaps", "last")).alias("__cut"))
    some = docs.where(has).join(gaps, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__of")), "left")
    some = some.withColumn("__blocks", F.when(F.col("__cut").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        """Characters a to b of the text, out of its blocks."""
        block = lambda k: F.coalesce(F.get("__blocks", k), F.lit(""))
        first, last = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
        at, to = (a % _BLOCK).cast("int"), (b % _BLOCK).cast("int")
        between = F.concat(F.substr(block(first), at + 1), F.array_join(F.slice("__blocks", first + 2, last - first - 1), ""), F.substr(block(last), F.lit(1), to))
        return F.when(first == last, F.substr(block(first), at + 1, to - at)).otherwise(between)

    kept = F.concat(F.col("__cut.gaps"), F.array(F.struct(F.col("__cut.last").alias("a"), F.length("text").cast("long").alias("b"))))
    text = F.array_join(F.transform(kept, lambda g: piece(g["a"], g["b"])), mark)
    some = some.withColumn("__new", F.when(F.col("__cut").isNotNull(), text).otherwise(F.col("text")))
    out = [F.col("__new").alias("text") if c == "text" else F.when(F.col("__cut").isNotNull(), F.length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return docs.where(~has).unionByName(some.select(*out))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS)], F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"), F.size("live").cast("long").alias("n_live"),
    )


QUERIES = {"op7_secrets": op7_secrets}
_SQL_KINDS = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}"), ("owned", r"[A-Za-z0-9+/_=-]{24,}"))
_SQL_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, source, {k} AS r, '{name}' AS kind, s, i, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS a FROM (
    SELECT doc_id, source, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, source, string_split(regexp_replace(coalesce(text, ''), '({p})', chr(64976) || '\\1' || chr(64976), 'g'), chr(64976)) AS p FROM documents))"""
    for k, (name, p) in enumerate(_SQL_KINDS)
)
ORACLE_SQL = {
    "op7_secrets": rf"""
WITH parts AS ({_SQL_PARTS}),
m AS (SELECT *, a + length(s) AS b, CASE WHEN r = 0 THEN regexp_extract(s, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END AS v FROM parts WHERE i % 2 = 1),
base AS (SELECT * FROM m WHERE r < 3 AND (r > 0 OR length(v) >= {ASSIGN_LEAST})),
more AS (SELECT * FROM m WHERE r = 3 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')
         AND NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = m.doc_id AND y.a < m.b AND m.a < y.b)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM more),
copied AS (SELECT v FROM cand GROUP BY v HAVING count(DISTINCT coalesce(split_part(source, '/', 1), '')) > {MAX_OWNERS}),
live AS (SELECT * FROM cand WHERE v NOT IN (SELECT v FROM copied)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM live WHERE r = 3),
bs AS (SELECT doc_id, count(*) FILTER (WHERE r = 0) AS x, count(*) FILTER (WHERE r = 1) AS y, count(*) FILTER (WHERE r = 2) AS z, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, r) AS t FROM base GROUP BY doc_id),
ss AS (SELECT doc_id, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, r) AS t FROM spans GROUP BY doc_id),
ls AS (SELECT doc_id, count(*) AS n FROM live GROUP BY doc_id)
SELECT d.doc_id, coalesce(x, 0) AS n_assign, coalesce(y, 0) AS n_access, coalesce(z, 0) AS n_hex, sha256(coalesce(bs.t, '')) AS base_sha256, coalesce(ss.t, '') AS spans, coalesce(n, 0) AS n_live
FROM documents d LEFT JOIN bs USING (doc_id) LEFT JOIN ss USING (doc_id) LEFT JOIN ls USING (doc_id)
""",
}

by_value(__name__)

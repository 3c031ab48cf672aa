"""Operator 6: secrets, by an incremental ledger of blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, documents, let, scratch, stored


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` are taken leftmost and without overlap; then those whose group `group` has fewer
    than `least` characters are dropped.  A change of a rule takes a new `version`, and only then are known blobs scanned again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs are taken whole, so a least length in the pattern finds the same matches as one that is asked for afterwards.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
#: 1 + the place of a rule among all; 'kind as listed' in an order of spans.
SPAN = "array<struct<start:int,place:int,stop:int,kind:string>>"


#: Lengths that are summed together: a running sum adds the sums of whole runs before it and what lies in its own.
RUN = 128


def running(values: Column) -> Column:
    """The running sums of an array of at least one number, without an array that grows element by element."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    runs = lambda v: F.sequence(F.lit(0), ((F.size(v) - 1) / RUN).cast("int"))

    def body(v: Column) -> Column:
        sums = F.transform(runs(v), lambda k: add(F.slice(v, k * RUN + 1, RUN)))
        before = let(sums, lambda s: F.transform(s, lambda _, k: add(F.slice(s, F.lit(1), k))))
        own = lambda i: add(F.slice(v, i - i % RUN + 1, i % RUN + 1))
        return let(before, lambda p: F.transform(v, lambda _, i: F.get(p, (i / RUN).cast("int")) + own(i)))

    return let(values, body)


def spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's spans in `text`, in code points, end exclusive.

    Splitting at the pattern gives what lies between the matches, so the places of matches are running sums
    of lengths.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else found
    between = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(n: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, F.lit(1), F.size(n)), n, lambda gap, x: gap + x))
        each = F.arrays_zip(n.alias("n"), ends.alias("stop"), kept.alias("k"))
        long_enough = F.filter(each, lambda x: x["k"] >= rule.least)
        span = lambda x: F.struct((x["stop"] - x["n"]).alias("start"), F.lit(place).alias("place"), x["stop"].alias("stop"), F.lit(rule.kind).alias("kind"))
        return F.transform(long_enough, span).cast(SPAN)

    return F.when(text.rlike(rule.pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): the spans of all `rules` in each row's text, and the ledger with what is new.

    A row is a version of a path, named by `id_cols`.  Contents are addressed by their SHA-256, each scanned
    once however many versions have it; of pairs of blob and rule version only those that the given ledger
    lacks are scanned.  The ledger has `blob`, `kind`, `version`, `spans`; a scan that found nothing has a
    row there, too.  Findings are `id_cols`, `blob` and `spans` (start, place, stop, kind; by start, then by the
    order of `rules`), one row for each row of `versions`.

    The text is read where one row of each blob stands: that of the smallest hash of its ids.  Texts are never shuffled
    but to meet the list of those rows, and not at all if nothing is unseen.  Null and empty texts have no spans.  Rows with null
    ids take part; repeated rows each get a row.  Long texts are scanned whole, in time that hardly grows faster than their
    matches.  An empty table gives no findings and adds nothing to the ledger.  Matches of two rules at one
    place are in the rules' order.  Other columns are left behind, whatever their names.
    """
    c = Carried(versions)
    ids = [c.col(n) for n in id_cols]
    text = F.coalesce(c.col(text_col), F.lit(""))
    paths = c.df.select(*[i.alias(f"__i{k}") for k, i in enumerate(ids)], text.alias("__text"))
    names = [f"__i{k}" for k in range(len(ids))]
    blob, at = F.sha2(F.encode("__text", "UTF-8"), 256), F.xxhash64(*names)
    light = stored(paths.select(*names, blob.alias("blob"), at.alias("__at")))
    blobs = light.groupBy("blob").agg(F.min("__at").alias("__at"))
    todo = blobs.crossJoin(F.broadcast(_rules(versions.sparkSession, rules))) if ledger is not None else blobs
    if ledger is not None:
        todo = todo.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti").groupBy("blob", "__at").agg(F.collect_set("place").alias("__rules"))
    if ledger is not None:
        todo = stored(todo)
    todo = todo.select(F.col("blob").alias("__blob"), F.col("__at").alias("__where"), *(["__rules"] if ledger is not None else []))
    texts = paths.withColumn("blob", blob).withColumn("__at", at)
    unseen = texts.join(todo, (F.col("__at") == F.col("__where")) & (F.col("blob") == F.col("__blob")))
    none = F.array().cast(SPAN)
    found = [spans(F.col("__text"), r, k) if ledger is None else F.when(F.array_contains("__rules", k), spans(F.col("__text"), r, k)) for k, r in enumerate(rules)]
    if ledger is not None and todo.isEmpty():
        unseen = unseen.limit(0)  # so the texts are not read
    new = unseen.select("blob", *[f.alias(f"__r{k}") for k, f in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"__r{k}").alias("spans")) for k, r in enumerate(rules)])
    fresh = new.select("blob", F.explode(rows).alias("x")).select("blob", "x.*").where("spans is not null").distinct()
    fresh = stored(fresh)
    whole = fresh if ledger is None else ledger.select("blob", "kind", "version", F.col("spans").cast(SPAN).alias("spans")).unionByName(fresh)
    current = whole.join(F.broadcast(_rules(versions.sparkSession, rules)), ["kind", "version"]).where(F.size("spans") > 0)
    # a place is that of the rules given now
    current = current.select("blob", F.explode("spans").alias("s"), "place").groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("place").alias("place"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind")))).cast(SPAN).alias("spans"))
    out = light.join(current, "blob", "left").select(*[F.col(f"__i{k}").alias(n) for k, n in enumerate(id_cols)], "blob", F.coalesce("spans", none).alias("spans"))
    return out, whole


LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def scan_with_ledger(versions: DataFrame, path: str, **options) -> DataFrame:
    """The findings of `scan_versions`, by the ledger stored at `path`, to which what is new is appended.

    A first run on a path that has no ledger starts one.  A run that is broken off before its append leaves the ledger as it was.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    known = spark.read.schema(LEDGER).parquet(path)
    found, whole = scan_versions(versions, known, **options)
    whole.join(known.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti").select("blob", "kind", "version", "spans").write.mode("append").parquet(path)
    return found


def _rules(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version, k) for k, r in enumerate(rules)], "kind string, version int, place int")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets.  Two runs against one stored ledger: the first scans all blobs, the second finds every pair
    of blob and rule version in the ledger, scans no text and joins the findings to all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = scratch(spark, "ledger")
    scan_with_ledger(docs, ledger)
    found = scan_with_ledger(docs, ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, list_sum(gaps[:i]) + coalesce(list_sum(sizes[:i - 1]), 0) AS start, list_sum(gaps[:i]) + list_sum(sizes[:i]) AS stop
  FROM (SELECT doc_id, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
      list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes,
      unnest(list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x))) AS took,
      generate_subscripts(regexp_extract_all(t, '{pattern}', 0), 1) AS i
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
  WHERE took >= {rule.least}"""


ORACLE = f"""
WITH spans AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}
), said AS (SELECT *, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id
"""

"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. A ledger says which rule versions have seen which blob and
what they found. A scan meets each distinct blob once, runs only the rule versions that the ledger lacks for it, and joins
the findings back to all paths (rows) that hold the blob. A changed pattern is a new rule version.

Functions that return the place of every match don't exist, so places are sums: a text's matches and the stretches between
them (split by the same pattern) alternate, and a running sum of their lengths gives each start, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, documents_only, table, unused


@dataclass(frozen=True)
class Rule:
    """group: of which at least `least` characters are asked; hint: a pattern that holds wherever the rule finds something."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Maximal runs that are long enough are the same as maximal runs, then dropped if short; not so for assignments, where a
# match that is dropped still takes its characters.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def _pieces(rule: Rule, order: int) -> Column:
    """For each match, in order: lengths of the stretch before it and of itself, and whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, rule.pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("x"))
    named = F.filter(zipped, lambda z: z["m"].isNotNull())  # split has one stretch more
    return F.transform(named, lambda z, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(z["g"]).cast("long").alias("gap"), F.length(z["m"]).cast("long").alias("len"), (F.length(z["x"]) >= rule.least).alias("ok")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind (index into rules), start, end of what rules find in blobs (blob, text, todo: names of the rules to run)."""
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:bigint,len:bigint,ok:boolean>>)")
    parts = [F.when(F.array_contains("todo", r.name), _pieces(r, k)).otherwise(none) for k, r in enumerate(rules)]
    each = blobs.select("blob", F.explode(F.concat(*parts)).alias("p")).select("blob", "p.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob", "kind").orderBy("i"))
    return each.withColumn("end", upto).where("ok").select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


@dataclass(frozen=True)
class Scan:
    paths: DataFrame  # doc_id, blob: every row
    findings: DataFrame  # blob, kind, start, end: of this scan and of the ledger, for the rule versions asked for
    seen: DataFrame  # blob, rule: the pairs scanned just now

    def ledger(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Rows to append to the ledger: a pair that found nothing has no spans."""
        names = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (k, r.name)])
        found = self.findings.groupBy("blob", names[F.col("kind")].alias("rule")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        return self.seen.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan the texts of docs (doc_id, text; null text: empty), except for what ledger (LEDGER) holds already.

    Rows with a null doc_id are paths like any other; equal texts are one blob, scanned once; an empty table scans nothing.
    """
    rows = documents_only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    todo = F.array(*[F.lit(r.name) for r in rules])
    old, unseen = None, rows.withColumn("todo", todo)
    if ledger is not None:
        old = cut(ledger.where(F.col("rule").isin([r.name for r in rules])))
        known = old.groupBy("blob").agg(F.collect_set("rule").alias("known"))
        left = F.array_except(todo, F.coalesce("known", F.array().cast("array<string>")))
        unseen = rows.join(bounded(cut(known)), "blob", "left").withColumn("todo", left).where(F.size("todo") > 0)
    # a text in which no hint occurs has no finding, so only its address travels
    hinted = F.when(F.col("text").rlike("|".join(r.hint for r in rules)), F.col("text"))
    blobs = unseen.groupBy("blob").agg(F.first("todo").alias("todo"), F.first(hinted).alias("text"))
    found = cut(scan_blobs(blobs.where("text is not null"), rules))
    if old is not None:
        kinds = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
        here = rows.select("blob").distinct()
        found = found.union(old.join(here, "blob", "left_semi").select("blob", kinds[F.col("rule")].alias("kind"), F.explode("spans").alias("s")).select("blob", "kind", "s.start", "s.end"))
    seen = unseen.select("blob", "todo").distinct().select("blob", F.explode("todo").alias("rule"))
    return Scan(rows.select("doc_id", "blob"), found, seen)


def per_document(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts (long, by rule, in order), spans (array of start, kind, end, sorted) for every row of docs (doc_id, text).

    Null and empty texts have no findings; rows that repeat a text, or a doc_id, or both, each get their text's findings;
    spans of two kinds may start at one place and are then in the rules' order. An empty table gives an empty one.
    """
    done = scan(docs, ledger, rules)
    counts = F.array(*[F.count_if(F.col("kind") == k) for k in range(len(rules))])
    found = done.findings.groupBy("blob").agg(counts.alias("counts"), F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    zero = F.array_repeat(F.lit(0).cast("long"), len(rules))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return done.paths.join(bounded(cut(found)), "blob", "left").select("doc_id", F.coalesce("counts", zero).alias("counts"), F.coalesce("spans", none).alias("spans"))


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, all columns, each run of found characters replaced by mark; n_chars, if there is one, follows.

    Null texts stay null, and texts without a finding stay as they are, with their n_chars. Of spans that overlap, the
    first takes the mark and the rest of the others goes with it. Repeated rows are masked alike; an empty table stays empty.
    """
    spans, blob = unused(docs, "spans", "blob")
    found = scan(docs).findings.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans)).withColumnRenamed("blob", blob)
    out = docs.join(bounded(cut(found)), F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(blob), "left")
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<string>").alias("parts"))
    before = lambda a, s: F.concat(F.substring(F.col("text"), a["upto"].cast("int") + 1, (s["start"] - a["upto"]).cast("int")), F.lit(mark))
    step = lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), F.when(s["start"] >= a["upto"], F.concat(a["parts"], F.array(before(a, s)))).otherwise(a["parts"]).alias("parts"))
    whole = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["upto"].cast("int") + 1, 2**31 - 1)))
    out = out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    each = F.transform("spans", lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"]))
    found = per_document(table(spark, sf_dir, "documents")).select("doc_id", "counts", F.array_join(each, ",").alias("spans"))
    return found.select("doc_id", *[F.col("counts")[k].alias(f"n_{r.kind}") for k, r in enumerate(RULES)], F.sha2("spans", 256).alias("base_sha256"), "spans")


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(x) AS x, unnest(g[1:len(m)]) AS g, {least} AS least FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS x, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS g FROM documents)"""


SQL = {
    "op10_secrets": f"""
WITH pieces AS ({_sql_kind(1, "assign", _ASSIGN, 2, 6)} UNION ALL {_sql_kind(2, "access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_sql_kind(3, "hex", "[0-9a-f]+", 0, 24)}),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM pieces),
kept AS (SELECT doc_id, k, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(x) >= least),
per AS (SELECT doc_id, count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS b, count(*) FILTER (k = 3) AS c, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
""",
}

"""Operator 6, secret scans with an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256).  The ledger, a
folder of two Parquet tables, remembers which (blob, rule version) pairs were
scanned and what was found.  A run

1. lists the blobs of all versions and the rules each has not been scanned
   with (anti join with the ledger),
2. scans one copy of each such blob with just these rules,
3. appends the pairs and findings to the ledger,
4. joins the findings of all blobs back to all versions.

So copies and versions that come again cost no scan, and a new rule (or a new
version of one) rescans old blobs with this rule alone.  Patterns run as
built-in regular expression functions; spans are code points, end exclusive,
found leftmost without overlap per rule.  The copy to scan is picked by
(blob, id), so a group of copies is spread over tasks by id.

Defined cases: null text is empty and has no finding; null ids and repeated
rows are versions like others, each with the findings of its text; an empty
table gives an empty result; extra columns are ignored, and kept by
:func:`redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.llm.common import fresh, scratch_path, spread, stored, text_or_empty
from gramloom.session import BROADCAST_BYTE_LIMIT, maybe_broadcast
from gramloom.sources.store import path_present


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched in full; a match counts if ``group`` has at
    least ``least`` code points.  Change ``version`` with the pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1


# The three base rules of the contract, in its order.  A run that
# is too short holds no longer match, so the length may stand in the pattern
# of "access" and "hex"; a short "assign" match does hide what it covers.
BASE_RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
                   "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 8, True),
    Rule("access", "AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", "[0-9a-f]{32,}", base=True),
)
# Published token formats, searched besides.
MORE_RULES = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    # The whole block; without an END line the base64 lines that follow, however
    # many.  Possessive loops run without recursion, and nothing after them
    # could need a line back.
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\\s*(?:Proc-Type|DEK-Info|Comment|Version): [^\\n]*)*+"
                        "(?:[A-Za-z0-9+/=\\s\\\\]*+-----END [A-Z ]*PRIVATE KEY-----|"
                        "(?:\\s*\\n[A-Za-z0-9+/=]{16,})*+(?:\\s*\\n[A-Za-z0-9+/]+={1,2})?)", version=3),
)
RULES = BASE_RULES + MORE_RULES


def _blob(text_col: str) -> Column:
    return F.sha2(F.encode(text_or_empty(text_col), "UTF-8"), 256)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` (blob, t, todo array of kinds) -> findings ``(blob, kind,
    version, start, end)``.  The text between matches and the matches give
    the positions by running sums."""
    pieces = []
    for r in rules:
        p = _quoted(r.pattern)
        pieces.append(F.expr(
            f"if(array_contains(todo, '{r.kind}') and t rlike '{p}', named_struct('kind', '{r.kind}', "
            f"'version', {r.version}, 'least', {r.least}, "
            f"'gaps', transform(split(t, '{p}', -1), x -> length(x)), "
            f"'sizes', transform(regexp_extract_all(t, '{p}', 0), x -> length(x)), "
            f"'marks', transform(regexp_extract_all(t, '{p}', {r.group}), x -> length(x))), null)"))
    # explode_outer: for explode, Catalyst would add a filter that evaluates all patterns once more.
    rows = (blobs.select("blob", F.array(*pieces).alias("r")).select("blob", F.explode_outer("r").alias("r"))
            .filter("r is not null").select("blob", "r.*"))
    each = rows.select("blob", "kind", "version", "least", F.posexplode(F.arrays_zip(
        F.slice("gaps", 1, F.size("sizes")).alias("gap"), F.col("sizes").alias("size"), F.col("marks").alias("mark")))
        .alias("at", "m")).distinct()  # repeated rows bring a blob twice
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto))
    return (ended.filter("m.mark >= least")
            .select("blob", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end"))


class Ledger:
    """Tables ``scanned`` (blob, kind, version) and ``findings`` (blob,
    kind, version, start, end) under ``path`` on shared storage."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if path_present(self.spark, path):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, kind string, version int")

    def findings(self) -> DataFrame:
        """A pair appended twice (a run that broke off between its two
        writes and came again) counts once."""
        return self._read("findings", "blob string, kind string, version int, start long, end long").distinct()

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
        """Scan what is new among ``versions``; returns all versions as
        ``(doc_id, blob)``, stored."""
        texts = spread(versions.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                       text_or_empty(text_col).alias("t"), _blob(text_col).alias("blob")))
        listed = stored(texts.select("doc_id", "blob"), "versions")
        kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        first = listed.groupBy("blob").agg(F.min("doc_id").alias("at"))
        todo = (first.select("blob", "at", F.explode(kinds).alias("r")).select("blob", "at", "r.*")
                .join(self.scanned(), ["blob", "kind", "version"], "left_anti"))
        todo = stored(todo.groupBy("blob", "at").agg(F.collect_set(F.struct("kind", "version")).alias("pairs")), "todo")
        if todo.isEmpty():
            return listed
        # Texts meet their pairs by (blob, id): no sort, and a group of copies is spread.
        need = todo.select(F.col("blob").alias("b"), "at", F.col("pairs.kind").alias("todo")).hint("shuffle_hash")
        blobs = (texts.join(need, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("at")))
                 .select("blob", "t", "todo"))
        spans(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        (todo.select("blob", F.explode("pairs").alias("p")).select("blob", "p.*")
         .write.mode("append").parquet(f"{self.path}/scanned"))
        return listed

    def by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``(blob, found)``: per blob the findings of the current rule
        versions, sorted by start, then rule order."""
        order = self.spark.createDataFrame([(r.kind, r.version, k, r.base) for k, r in enumerate(rules)],
                                           "kind string, version int, rank int, base boolean")
        return (self.findings().join(F.broadcast(order), ["kind", "version"]).groupBy("blob")
                .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "base"))).alias("found")))


def _joined(found: str) -> str:
    return f"concat_ws(',', transform({found}, x -> concat_ws(':', x.kind, x.start, x.end)))"


def find_secrets(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, blob, found)``, ``found`` sorted by
    start and rule."""
    ledger = ledger or Ledger(docs.sparkSession)
    listed = ledger.scan(docs, rules, id_col, text_col)
    return (listed.join(ledger.by_blob(rules), "blob", "left")
            .withColumn("found", F.coalesce("found", F.expr(
                "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>)"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of :func:`find_secrets`."""
    n = {r.kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}")
         for r in BASE_RULES}
    return found.select("doc_id", *n.values(), F.expr(f"sha2({_joined('filter(found, x -> x.base)')}, 256)").alias("base_sha256"),
                        F.expr(_joined("found")).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]",
           id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by
    ``mark``; ``length_col``, if there, follows the new text.  Clean rows
    stay as they are."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules, id_col, text_col)
    # The union of the spans, as the sorted ends of the text parts to keep.
    cuts = stored(ledger.by_blob(rules).select("blob", F.expr(
        "aggregate(found, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> "
        "if(size(a) > 0 and x.start < element_at(a, -1).e, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, "
        "'e', greatest(element_at(a, -1).e, x.end)))), "
        "concat(a, array(named_struct('s', x.start, 'e', x.end)))))").alias("cuts")), "cuts")
    # A blob is 64 characters, a span two longs and their place.
    n, size = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum(64 + 32 * F.size("cuts")), F.lit(0))).first()
    bound = n if size <= BROADCAST_BYTE_LIMIT else None
    key, spans_ = fresh(docs, "blob"), fresh(docs, "cuts")
    joined = (spread(docs).withColumn(key, _blob(text_col))
              .join(maybe_broadcast(cuts.select(F.col("blob").alias(key), F.col("cuts").alias(spans_)), bound),
                    key, "left"))
    c = f"`{spans_}`"
    text = F.expr(
        f"if({c} is null, `{text_col}`, array_join(transform(sequence(0, size({c})), i -> substring(`{text_col}`, "
        f"cast(coalesce(get({c}, i - 1).e, 0) as int) + 1, "
        f"cast(coalesce(get({c}, i).s, length(`{text_col}`)) - coalesce(get({c}, i - 1).e, 0) as int))), '{mark}'))")
    out = joined.withColumn(text_col, text)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(spans_).isNull(), F.col(length_col))
                             .otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])

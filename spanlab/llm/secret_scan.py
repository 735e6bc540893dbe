"""Secret scans over an incremental blob ledger (operator 9, native).

Every historical version of a file is content-addressed (SHA-256 of its text). The
ledger holds the (blob, rule version) pairs already scanned; a run scans only the
pairs it does not hold, each blob once however many paths or versions carry it,
appends findings and pairs, and joins the findings back to all paths. Everything is
built-in SQL: match positions come from the lengths of the pieces between matches
(``split``) and of the matches (``regexp_extract_all``).

Defined results: a null text is the empty text (no finding); a null path is kept; an
empty table gives an empty result; repeated rows share one blob and each gets its
findings; extra columns of the input are ignored. Offsets are code points, ends are
exclusive. A match of a rule is dropped when it is shorter than the rule's minimum,
after matching, so what it covered is not searched again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import let, table, written


@dataclass(frozen=True)
class Rule:
    """One rule version: ``group`` 0 measures the whole match, else that capture group."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which their spans are listed.
BASE_RULES = [
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
]
# Rules beyond the base: tokens with a fixed prefix, private-key blocks, signed web tokens.
MORE_RULES = [
    Rule("prefixed", 1, r"(?:ghp|gho|ghs|glpat|xoxb|xoxp)[_-][A-Za-z0-9-]{20,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
]
RULES = BASE_RULES + MORE_RULES

FINDINGS = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def blob_id(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 text (null: of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


# Elements of a fold that grow one array or string; longer lists fold run by run.
RUN = 256


def runs_of(items: Column) -> Column:
    """An array cut into runs of ``RUN`` elements (an empty one: a single empty run)."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * RUN + 1, RUN))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: leftmost, non-overlapping matches that pass its minimum.

    Offsets are running sums over the gaps and matches, folded run by run, so that the work
    is linear in the matches of a text but for one short list per run.
    """
    pattern = F.lit(rule.pattern)
    full = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = full if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(
        F.transform(gaps, lambda g: F.char_length(g)).alias("gap"),
        F.transform(full, lambda m: F.char_length(m)).alias("len"),
        F.transform(measured, lambda m: F.char_length(m)).alias("size"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    no_runs = F.array().cast("array<array<struct<start:int,end:int>>>")

    def state(at, out):
        # where the last match ended and what was kept
        return F.struct(at.alias("at"), out.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        keep = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return state(end, F.when(x["size"] >= rule.least, F.concat(acc["out"], keep)).otherwise(acc["out"]))

    def run(acc, xs):
        inner = F.aggregate(xs, state(acc["at"], empty), step)
        return let(inner, lambda r: state(r["at"], F.concat(acc["out"], F.array(r["out"]))))

    matched = F.filter(rows, lambda x: x["len"].isNotNull())
    spans = let(matched, lambda m: F.aggregate(runs_of(m), state(F.lit(0), no_runs), run, lambda acc: F.flatten(acc["out"])))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def cut_spans(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``mark``; overlapping ones are merged.

    The text is cut into one piece per run of spans first, so that no span looks from the
    start of a long text.
    """

    def run(acc, xs):
        piece = F.substring(text, acc["at"] + 1, F.element_at(xs, -1)["start"] - acc["at"])

        def step(inner, s):
            # a span that starts inside the last one only moves the end on
            gap = F.substring(inner["piece"], inner["at"] - acc["at"] + 1, s["start"] - inner["at"])
            out = F.when(s["start"] >= inner["at"], F.concat(inner["out"], gap, F.lit(mark))).otherwise(inner["out"])
            return F.struct(F.greatest(inner["at"], s["end"]).alias("at"), inner["piece"].alias("piece"), out.alias("out"))

        start = F.struct(acc["at"].alias("at"), piece.alias("piece"), F.lit("").alias("out"))
        return let(
            F.aggregate(xs, start, step),
            lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
        )

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        runs_of(spans), none, run, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def scan_versions(
    versions: DataFrame,
    rules: list[Rule] = RULES,
    path: str = "path",
    text: str = "text",
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan every version of every path that the ledger does not know yet.

    ``versions`` has one row per historical version (``path`` and ``text``; a path may
    repeat). ``ledger`` holds (``blob``, ``rule``) pairs, ``findings`` the rows of
    earlier runs (``FINDINGS``). Returns ``(by_path, new_pairs, all_findings)``: one row
    per input row with its blob and its findings (an array over kinds with spans), the
    pairs this run scanned, and the findings including earlier ones.
    """
    spark = versions.sparkSession
    base = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paths = written(base.select("path", blob_id(F.col("text")).alias("blob")), "secret-paths")
    pairs = paths.select("blob").distinct().select(
        "blob", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule")
    )
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
    pairs = written(pairs, "secret-pairs")

    # One copy of each unseen blob is scanned: the one at its least path.
    todo = pairs.groupBy("blob").agg(F.collect_set("rule").alias("todo"))
    chosen = todo.join(paths.groupBy("blob").agg(F.min("path").alias("path")), "blob")
    texts = base.withColumn("blob", blob_id(F.col("text"))).alias("t")
    same = F.col("t.path").eqNullSafe(F.col("c.path")) & (F.col("t.blob") == F.col("c.blob"))
    one = texts.join(chosen.alias("c"), same).select("t.blob", "t.text", "c.todo")
    found = one.select(
        "blob",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r.kind).alias("kind"),
                        F.lit(r.version).alias("version"),
                        F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r)).alias("spans"),
                    )
                    for r in rules
                ]
            )
        ).alias("f"),
    ).select("blob", "f.*")
    found = found.filter(F.size("spans") > 0)
    # repeated rows of one path and text were scanned alike
    found = found.groupBy("blob", "kind", "version").agg(F.first("spans").alias("spans"))
    found = written(found, "secret-findings")
    if findings is not None:
        found = findings.select("blob", "kind", "version", "spans").unionByName(found)
    keys = [r.key for r in rules]
    current = found.filter(F.concat_ws("@", "kind", F.col("version").cast("string")).isin(keys))
    per_blob = current.groupBy("blob").agg(F.collect_list(F.struct("kind", "version", "spans")).alias("findings"))
    by_path = paths.join(per_blob, "blob", "left")
    return by_path, pairs, found


def spans_string(findings: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of the given kinds, by start, then by the order of ``kinds``, comma-joined."""
    ranks = F.array(*[F.lit(k) for k in kinds])
    flat = F.flatten(
        F.transform(
            F.filter(findings, lambda f: F.array_contains(ranks, f["kind"])),
            lambda f: F.transform(
                f["spans"],
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.array_position(ranks, f["kind"]).alias("rank"),
                    s["end"].alias("end"),
                    f["kind"].alias("kind"),
                ),
            ),
        )
    )
    return F.array_join(
        F.transform(
            F.sort_array(flat),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def kind_count(findings: Column, kind: str) -> Column:
    return F.aggregate(
        F.filter(findings, lambda f: f["kind"] == kind),
        F.lit(0).cast("bigint"),
        lambda acc, f: acc + F.size(f["spans"]),
    )


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document (path = doc_id, one version each, empty ledger)."""
    docs = table(spark, sf_dir, "documents")
    by_path, _, _ = scan_versions(docs.select("doc_id", "text"), RULES, path="doc_id")
    f = F.coalesce(F.col("findings"), F.array().cast("array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>"))
    base_kinds = [r.kind for r in BASE_RULES]
    return by_path.select(
        F.col("path").alias("doc_id"),
        kind_count(f, "assign").alias("n_assign"),
        kind_count(f, "access").alias("n_access"),
        kind_count(f, "hex").alias("n_hex"),
        F.sha2(spans_string(f, base_kinds), 256).alias("base_sha256"),
        spans_string(f, [r.kind for r in RULES]).alias("spans"),
    )


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by ``[secret]``; every document stays.

    The spans that the ledger found in a row's text are cut out of it, whatever its id; overlapping spans are
    merged first. ``n_chars`` follows the new text. Null texts stay null.
    """
    by_path, _, _ = scan_versions(docs.select("doc_id", "text"), RULES, path="doc_id")
    # spans belong to a text, not to an id: rows that share an id may hold different texts
    hits = by_path.filter(F.size("findings") > 0).select(
        F.col("blob").alias("_blob"),
        F.sort_array(F.flatten(F.transform("findings", lambda f: f["spans"]))).alias("_spans"),
    ).groupBy("_blob").agg(F.first("_spans").alias("_spans"))
    # written first, so its size is known when the join is planned: a small list moves no text
    hits = written(hits, "secret-hits")
    columns = docs.columns
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut_spans(F.col("text"), F.col("_spans")))
    out = docs.join(hits, blob_id(docs["text"]) == hits["_blob"], "left").withColumn("text", text).drop("_blob", "_spans")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)

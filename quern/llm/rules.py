"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions.

Everything here is DataFrame and SQL work. The measures of a text are built-in expressions over its words and
lines; they are written once to the shared folder, and both learning and judging read that small table.

Learning: candidates for a condition are thresholds at quantiles of each measure, and halfway between good and bad ones.
Each step counts, over all labelled rows of the growing part, how many good and bad rows every candidate would keep. The rule takes
the condition with the best gain until it covers no good row; then trailing conditions are cut as long as that
doesn't lower its worth on the pruning part. A rule enters the list if it is precise on both parts; the rows it
covers leave, and the next rule is grown. The list ends where no such rule is found. Labels only teach; a verdict
depends on the text alone.

Defined results: a null or empty text has no words, and so fails the base; labels that are null, or of ids that
``docs`` lacks, teach nothing, and an id labelled twice teaches twice; without labelled rows of both kinds the list
is empty and only the base decides; ties between candidates go to the first in the order of measures and
thresholds; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, table

SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?.,;:"
#: Runs of characters that no count by character looks at.
NOT_COUNTED = "[^A-Z" + "".join(f"\\{c}" for c in SYMBOLS + MARKS) + "]+"
_PLACE = (1 << 32) - 1
QUANTILES = 24
BAD_CUTS = [0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98]
GOOD_ENDS = [0.0, 0.005, 0.995, 1.0]
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_COVER = 20
MIN_PRECISION = 0.97
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "mark_share", "line_words", "bang_share", "n_words")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.measure)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the learner's measures of every whole text, and the row itself as a struct ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    nothing = F.array().cast("array<string>")
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.when(bare == "", nothing).otherwise(F.split(bare, SPACES)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "").alias("lines"),
        # What is counted by character, and nothing else, so that each count goes over a short string.
        F.regexp_replace(text, NOT_COUNTED, "").alias("signs"),
    )

    def kept_out(chars: str) -> Column:
        return (F.char_length("signs") - F.char_length(F.translate("signs", chars, ""))).cast("long")

    step = step.select(
        "row",
        "row.doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept_out(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        kept_out(UPPER).alias("n_upper"),
        kept_out(MARKS).alias("n_marks"),
        kept_out("!").alias("n_bangs"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )

    def window(h: Column, i: Column) -> Column:
        """The hash of the three words from ``i`` on, the first of which has the hash ``h``."""
        return F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))

    # Half of a window's hash above its place: plain numbers, whose sorting brings equal windows together.
    begins = F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0)))
    packed = F.transform(begins, lambda h, i: window(h, i).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
    step = step.withColumn("packed", F.sort_array(packed))

    def half(x: Column) -> Column:
        return F.shiftright(x, 32)

    packed = F.col("packed")
    alike = F.filter(packed, lambda x, k: (half(x) == half(F.get(packed, k + 1))) | (half(x) == half(F.get(packed, k - 1))))
    step = step.withColumn("alike", F.transform(alike, lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))).drop("packed")
    # Only windows that share half of their hash with another can be equal; these are sorted by the whole hash.
    windows = F.transform("alike", lambda i: F.struct(window(F.get("hashes", i), i).alias("h"), i.alias("i")))
    step = step.withColumn("windows", F.sort_array(windows)).drop("alike", "hashes")
    windows = F.col("windows")
    starts = F.filter(
        F.transform(
            windows,
            lambda x, k: F.when((x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    step = step.withColumn("starts", starts).drop("windows")
    covered = F.size(
        F.array_union(F.array_union("starts", F.transform("starts", lambda i: i + 1)), F.transform("starts", lambda i: i + 2))
    )
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("starts")


def shares(counts: DataFrame) -> DataFrame:
    """Adds the learner's measures to the counts."""

    def over(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return counts.withColumns(
        {
            "symbol_share": over("n_symbols", "word_chars"),
            "dup_line_share": over("n_dup_lines", "n_lines"),
            "repeat_share": over("n_repeat_words", "n_words"),
            "word_length": over("word_chars", "n_words"),
            "upper_share": over("n_upper", "word_chars"),
            "mark_share": over("n_marks", "n_words"),
            "line_words": over("n_words", "n_lines"),
            "bang_share": over("n_bangs", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def _covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _not_covered(rules: list[Rule]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & ~_covers(r)
    return out


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """What a condition gains: bad rows kept, times the rise of their share in bits."""
    bad, good = after
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(before[0] / (before[0] + before[1])))


def learn(spark: SparkSession, labelled: DataFrame, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list for ``bad`` rows of ``labelled`` (MEASURES, bad, part: true for growing, false for pruning).

    Each row is reduced to the bins of its measures once, so a step counts bins and sums them up to candidates."""

    def totals(rows: Column, wanted: list[Column]) -> list[tuple[int, int]]:
        cols = []
        for k, c in enumerate(wanted):
            cols += [F.count_if(rows & c & F.col("bad")).alias(f"b{k}"), F.count_if(rows & c & ~F.col("bad")).alias(f"g{k}")]
        got = binned.agg(*cols).first()
        return [(got[f"b{k}"], got[f"g{k}"]) for k in range(len(wanted))]

    def quantiles(kind: str, at: list[float]) -> dict[str, list[float]]:
        got = labelled.where(kind).agg(*[F.percentile_approx(m, at, 10_000).alias(m) for m in MEASURES]).first()
        return {m: [float(t) for t in got[m] or []] for m in MEASURES}

    cuts = quantiles("part", [q / QUANTILES for q in range(1, QUANTILES)])
    bad, good = quantiles("part and bad", BAD_CUTS), quantiles("part and not bad", GOOD_ENDS)
    # Halfway between where good rows end and where bad rows are leaves both a margin.
    steps = {m: sorted({*cuts[m], *bad[m], *((g + b) / 2 for g in good[m] for b in bad[m])}) for m in MEASURES}

    def bin_of(m: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, steps[m])).cast("array<double>"), lambda t: t <= F.col(m)))

    bins = F.array(*[F.struct(F.lit(k).alias("m"), bin_of(m).alias("bin")) for k, m in enumerate(MEASURES)])
    binned = materialize(spark, labelled.withColumn("bins", bins), "binned")

    def counted(rows: Column) -> list[tuple[Condition, tuple[int, int]]]:
        """Each candidate with the bad and good rows that it would keep."""
        cells = binned.where(rows).select("bad", F.explode("bins").alias("c")).groupBy("c.m", "c.bin")
        got = cells.agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()
        out = []
        for k, m in enumerate(MEASURES):
            own = {r["bin"]: (r["b"], r["g"]) for r in got if r["m"] == k}
            all_b, all_g = (sum(v[j] for v in own.values()) for j in (0, 1))
            low_b = low_g = 0
            for j, t in enumerate(steps[m]):
                b, g = own.get(j, (0, 0))
                low_b, low_g = low_b + b, low_g + g
                out.append((Condition(m, True, t), (all_b - low_b, all_g - low_g)))
                out.append((Condition(m, False, t), (low_b, low_g)))
        return out

    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = _not_covered(rules)
        rule: list[Condition] = []
        now = totals(left & F.col("part"), [F.lit(True)])[0]
        if now[0] < MIN_COVER:
            break
        while now[1] and len(rule) < MAX_CONDITIONS:
            candidates = counted(left & F.col("part") & _covers(tuple(rule)))
            gains = [_gain(now, x) if x[0] >= MIN_COVER else -math.inf for _, x in candidates]
            best = max(range(len(gains)), key=gains.__getitem__, default=None)
            if best is None or gains[best] <= 0:
                break
            rule.append(candidates[best][0])
            now = candidates[best][1]
        if not rule:
            break
        # Prune: the shortest beginning of the rule that is worth most on rows that it wasn't grown on.
        held = totals(left & ~F.col("part"), [_covers(tuple(rule[: k + 1])) for k in range(len(rule))])
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in held]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        final = tuple(rule[: keep + 1])
        (gb, gg), (pb, pg) = totals(left & F.col("part"), [_covers(final)])[0], held[keep]
        if gb + pb < MIN_COVER or not pb or min(gb / (gb + gg), pb / (pb + pg)) < min_precision:
            break
        rules.append(final)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that rejects, or null."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(_covers(rule), k) if out is None else out.when(_covers(rule), k)
    return F.lit(None).cast("int") if out is None else out


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the first rule that rejects, or null) and kept, one row a document.

    With ``whole``, also the document itself as a struct ``row``."""
    counts = measures(docs)
    counts = materialize(spark, counts if whole else counts.drop("row"), "measures")
    rows = shares(counts)
    taught = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    labelled = rows.join(taught, "doc_id").where("not base_failed")
    labelled = labelled.select(*MEASURES, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("part"))
    rules = learn(spark, materialize(spark, labelled, "labelled"))
    return rows.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )

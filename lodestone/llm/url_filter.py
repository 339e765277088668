"""URL filters: rules first, else the likelihood ratio of two character models.

Two variable-order Markov models (interpolated Witten-Bell smoothing over all orders up to a limit) are trained on
accepted and on rejected URLs. A URL is judged by the difference of its log-likelihoods per character, against a
threshold calibrated on accepted and rejected URLs of hosts that neither model has seen.

All different URLs count, for the models and for the threshold. The counts are tables: of grams, which are a character and
the ``ORDER`` before it, and of their shorter ends, from which each order's probabilities follow by a join with the order
below. Neither the driver nor a task holds a model; a gram's contexts have at most as many rows as there are characters.
URLs of any length are cut into grams in one pass; an empty table has models that say nothing, and the threshold 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import slices, text_batches
from lodestone.sources.scratch import broadcast_if_small, keep, release

#: (verdict, host, path) of the rules; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parts of host names that mark a URL as an example of the rejected, where no table marks any. Only training uses them: what
#: the models make of them is what a URL is judged by.
SEEDS = r"casino|(^|[.-])bets?([.-]|$)|poker|pills?([.-]|$)|(^|[.-])ads?[.-]|porn|xxx|viagra|loan|jackpot|spam"
ORDER = 5
#: Steps of a log ratio: sums of whole numbers do not depend on their order.
STEPS = 1 << 30
#: Different grams that a task counts before it gives them out.
HELD = 200_000
#: Share of accepted URLs that the threshold may turn down.
MISSED = 0.02


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    # (?s) and \z: a line feed in a URL is a character like any other.
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host and path fit, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class CharModel:
    """A variable-order Markov model of characters: orders 0 to ``order``, interpolated by Witten and Bell."""

    START, END = "\x02", "\x03"

    def __init__(self, texts: list[str], order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[str, Counter] = defaultdict(Counter)
        letters = {self.END}
        for text in texts:
            line = self.START * order + text + self.END
            letters.update(text)
            for i in range(order, len(line)):
                for n in range(order + 1):
                    self.counts[line[i - n : i]][line[i]] += 1
        self.letters = len(letters) + 1
        self.totals = {c: (sum(x.values()), len(x)) for c, x in self.counts.items()}

    def log_p(self, context: str, char: str) -> float:
        p = 1.0 / self.letters
        for n in range(len(context) + 1):
            c = context[len(context) - n :]
            if (total := self.totals.get(c)) is None:
                break
            seen, different = total
            p = (self.counts[c].get(char, 0) + different * p) / (seen + different)
        return math.log(p)


@dataclass
class UrlModel:
    """Models of a list of accepted and rejected URLs, and the threshold of the mean log ratio from which a URL is accepted."""

    accepted: CharModel
    rejected: CharModel
    threshold: float = 0.0
    #: Of the URLs set aside: how many were accepted and rejected examples, and the shares of both that are judged wrongly.
    aside: tuple[int, int, float, float] = (0, 0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.known: dict[tuple[str, str], float] = {}

    def ratio(self, text: str) -> float:
        """Log-likelihood difference (accepted less rejected) per character, the end included."""
        order, known, total = self.accepted.order, self.known, 0.0
        if len(known) > 500_000:
            known.clear()
        line = CharModel.START * order + text + CharModel.END
        for i in range(order, len(line)):
            key = (line[i - order : i], line[i])
            if (d := known.get(key)) is None:
                d = known[key] = self.accepted.log_p(*key) - self.rejected.log_p(*key)
            total += d
        return total / (len(line) - order)

    def accepts(self, text: str) -> bool:
        return self.ratio(text) >= self.threshold


@dataclass
class UrlTables:
    """The models of all URLs of a table, as written tables, and the threshold.

    ``counts`` has (gram, allow, block): how often each occurs in accepted and rejected examples. ``levels`` has for each order
    (part, context, p_allow, p_block, b_allow, b_block): the probabilities of a part's last character after those before it, its
    context, and the weights that the context leaves to the order below.
    """

    counts: DataFrame
    levels: list[DataFrame]
    #: Probabilities of a character of which nothing is known.
    base: tuple[float, float]
    threshold: float = 0.0
    #: As in UrlModel.
    aside: tuple[int, int, float, float] = (0, 0, 0.0, 0.0)
    known: dict[tuple[bool, str], tuple[float, float] | None] = field(default_factory=dict)

    def ratio(self, text: str) -> float:
        """As of UrlModel, for one text at hand: reads what its grams need, and remembers it. Tables are judged by judge_urls."""
        line = CharModel.START * ORDER + text + CharModel.END
        grams = [line[i : i + ORDER + 1] for i in range(len(line) - ORDER)]
        if len(self.known) > 500_000:
            self.known.clear()
        self._read({(is_part, g[ORDER - n : ORDER + is_part]) for g in grams for n in range(ORDER + 1) for is_part in (False, True)} - self.known.keys())
        return sum(self._log_ratio(g) for g in grams) / len(grams)

    def _read(self, wanted: set[tuple[bool, str]]) -> None:
        if not wanted:
            return
        self.known.update(dict.fromkeys(wanted))
        for n, level in enumerate(self.levels):
            for is_part, name, of in ((True, "part", "p"), (False, "context", "b")):
                asked = [s for k, s in wanted if k == is_part and len(s) == n + is_part]
                if asked:
                    for r in level.filter(F.col(name).isin(asked)).select(name, f"{of}_allow", f"{of}_block").distinct().collect():
                        self.known[is_part, r[0]] = (r[1], r[2])

    def _log_ratio(self, gram: str) -> float:
        p = self.base
        for n in range(ORDER + 1):
            if (left := self.known[False, gram[ORDER - n : ORDER]]) is None:
                break
            p = self.known[True, gram[ORDER - n :]] or (p[0] * left[0], p[1] * left[1])
        return math.log(p[0]) - math.log(p[1])

    def accepts(self, text: str) -> bool:
        return self.ratio(text) >= self.threshold


def model_text(host: str, path: str) -> str:
    """What the models read: host and path, digits made alike."""
    return "".join("0" if c.isdigit() else c for c in host + path)


_DIGITS = "".join(c for c in map(chr, range(0x110000)) if c.isdigit())


def _model_text() -> Column:
    return F.translate(F.concat("host", "path"), _DIGITS, "0" * len(_DIGITS))


def train(rows: list[tuple[str, str]], missed: float = MISSED) -> UrlModel:
    """Models from a list of (verdict, text) rows, as fit_url_model makes them of a table. A fifth of the hosts, by CRC-32, is set aside and calibrates the threshold.

    The threshold is the one that parts accepted and rejected URLs set aside best (the largest sum of the shares that are judged
    rightly) among those that turn down at most a share ``missed`` of the accepted; half way to the next ratio, so that it does
    not touch either. It is 0, where both models are equally likely, if either kind is missing there.
    """
    aside, rest = [], []
    for row in rows:
        (aside if zlib.crc32(row[1].split("/", 1)[0].encode("utf-8", "surrogatepass")) % 5 == 0 else rest).append(row)
    model = UrlModel(CharModel([t for v, t in rest if v == "allow"]), CharModel([t for v, t in rest if v == "block"]))
    good, bad = (np.sort([model.ratio(t) for v, t in aside if v == verdict]) for verdict in ("allow", "block"))
    if len(good) and len(bad):
        every = np.unique(np.concatenate([good, bad]))
        cuts = np.concatenate([every[:1] - 1e-6, (every[1:] + every[:-1]) / 2, every[-1:] + 1e-6])
        turned, passed = np.searchsorted(good, cuts) / len(good), 1 - np.searchsorted(bad, cuts) / len(bad)
        allowed = np.flatnonzero(turned <= missed)
        model.threshold = float(cuts[allowed[np.argmin((turned + passed)[allowed])]])
    if len(good) or len(bad):
        model.aside = (len(good), len(bad), float((good < model.threshold).mean()) if len(good) else 0.0, float((bad >= model.threshold).mean()) if len(bad) else 0.0)
    return model


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, and ``rule`` and ``verdict`` where a rule fits."""
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _grams_of(text: str) -> Counter:
    line = CharModel.START * ORDER + text + CharModel.END
    return Counter(line[i : i + ORDER + 1] for i in range(len(line) - ORDER))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, allow, block) of (text, allow, block): how often each gram occurs, times the text's numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.string()), ("allow", pa.int64()), ("block", pa.int64())])
        held: dict[str, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            yield from slices({"gram": list(held), "allow": [x[0] for x in held.values()], "block": [x[1] for x in held.values()]}, schema)
            held.clear()

        for batch in batches:
            for text, allow, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram, times in _grams_of(text).items():
                    sums = held.setdefault(gram, [0, 0])
                    sums[0] += times * allow
                    sums[1] += times * block
                if len(held) > HELD:
                    yield from out()
        if held:
            yield from out()

    rows = texts.select("text", "allow", "block").mapInArrow(counted, "gram string, allow long, block long")
    return rows.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def gram_levels(counts: DataFrame) -> tuple[list[DataFrame], tuple[float, float]]:
    """The ``levels`` and ``base`` of UrlTables. Grams counted 0 times get the probabilities that the others leave to them."""
    levels, below, base = [], None, (0.5, 0.5)
    sides = ("allow", "block")
    for n in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER + 1 - n, n + 1).alias("part")).agg(*[F.sum(v).alias(v) for v in sides])
        level = level.withColumn("context", F.substring("part", 1, n))
        follow = Window.partitionBy("context")  # at most as many rows as there are different characters
        seen = [F.sum(v).over(follow).alias(f"seen_{v}") for v in sides]
        different = [F.sum((F.col(v) > 0).cast("long")).over(follow).alias(f"different_{v}") for v in sides]
        level = level.select("*", *seen, *different)
        if below is None:
            level = keep(level, "url-characters")
            levels.append(level)
            row = level.select(*[f"different_{v}" for v in sides]).first()
            base = tuple(1.0 / (max(x, 1) + 1) for x in row) if row else base
            level = level.withColumns({f"q_{v}": F.lit(base[k]) for k, v in enumerate(sides)})
        else:
            under = below.select(F.col("part").alias("end"), *[F.col(f"p_{v}").alias(f"q_{v}") for v in sides])
            level = level.withColumn("end", F.substring("part", 2, n)).join(under, "end")
        found = []
        for v in sides:
            n_v, seen_v, different_v, q = F.col(v), F.col(f"seen_{v}"), F.col(f"different_{v}"), F.col(f"q_{v}")
            found.append(F.when(seen_v > 0, (n_v + different_v * q) / (seen_v + different_v)).otherwise(q).alias(f"p_{v}"))
            found.append(F.when(seen_v > 0, different_v / (seen_v + different_v)).otherwise(F.lit(1.0)).alias(f"b_{v}"))
        below = keep(level.select("part", "context", *found), "url-level")
        levels.append(below)
    release(levels.pop(0))
    return levels, base


def _text_ratios(texts: DataFrame, level: DataFrame) -> DataFrame:
    """(id, ratio) of (id, text), ids unique: the mean log ratio of its grams, which the highest level all has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("gram", pa.string()), ("times", pa.int64())])
        for batch in batches:
            rows: dict[str, list] = {"id": [], "gram": [], "times": []}
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = _grams_of(text)
                rows["id"] += [number] * len(grams)
                rows["gram"] += grams.keys()
                rows["times"] += grams.values()
            yield from slices(rows, schema)

    step = F.round((F.log("p_allow") - F.log("p_block")) * STEPS).cast("long")
    steps = keep(level.select(F.col("part").alias("gram"), step.alias("step")), "url-steps")
    grams = texts.select("id", "text").mapInArrow(cut, "id long, gram string, times long")
    sums = grams.join(broadcast_if_small(steps), "gram").groupBy("id").agg(F.sum(F.col("step") * F.col("times")).alias("steps"), F.sum("times").alias("n"))
    return sums.select("id", (F.col("steps") / (F.col("n") * F.lit(float(STEPS)))).alias("ratio"))


def best_cut(examples: DataFrame, missed: float = MISSED) -> tuple[float, tuple[int, int, float, float]]:
    """(threshold, aside) of (ratio, allow, block), as in ``train``: running sums in ranges of the ratio, so no task has all rows."""
    spark = examples.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = examples.groupBy("ratio").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).repartitionByRange(ranges, "ratio")
    ranged = keep(ranged.withColumn("range", F.spark_partition_id()), "url-ratios")
    # One row a range.
    sums = ranged.groupBy("range").agg(F.min("ratio").alias("first"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).orderBy("range").collect()
    good, bad = sum(r["allow"] for r in sums), sum(r["block"] for r in sums)
    threshold = 0.0
    if good and bad:
        before, start = [0, 0], []
        for k, r in enumerate(sums):
            start.append((r["range"], *before, sums[k + 1]["first"] if k + 1 < len(sums) else None))
            before = [before[0] + r["allow"], before[1] + r["block"]]
        start = spark.createDataFrame(start, "range int, allow_before long, block_before long, following double")
        of_range = Window.partitionBy("range").orderBy("ratio")
        cuts = ranged.join(F.broadcast(start), "range").select(
            "ratio",
            ((F.sum("allow").over(of_range) + F.col("allow_before")) / good).alias("turned"),
            (1 - (F.sum("block").over(of_range) + F.col("block_before")) / bad).alias("passed"),
            F.coalesce(F.lead("ratio").over(of_range), "following").alias("next"),
        )
        cut = F.coalesce((F.col("ratio") + F.col("next")) / 2, F.col("ratio") + 1e-6)
        best = cuts.filter(F.col("turned") <= missed).orderBy(F.col("turned") + F.col("passed"), "ratio").select(cut.alias("cut"), "turned", "passed").first()
        # Before the first ratio nothing is turned down and all is passed.
        threshold = best["cut"] if best and best["turned"] + best["passed"] < 1 else sums[0]["first"] - 1e-6
    wrong = ranged.agg(F.sum(F.when(F.col("ratio") < threshold, F.col("allow"))).alias("turned"), F.sum(F.when(F.col("ratio") >= threshold, F.col("block"))).alias("passed")).first()
    release(ranged)
    return threshold, (good, bad, (wrong["turned"] or 0) / good if good else 0.0, (wrong["passed"] or 0) / bad if bad else 0.0)


def fit_url_model(pages: DataFrame, rules=RULES, seeds: str = SEEDS) -> UrlTables:
    """Train on all different URLs; the threshold is set by those of a fifth of the hosts, which the models do not see.

    Rejected are those that a rule blocks or whose host has a part that matches ``seeds``; accepted are those that a rule
    allows and, since no table marks them, the rest.
    """
    text_batches(pages.sparkSession)
    judged = with_rules(pages, rules).filter(F.col("host") != "")
    example = F.when(F.col("host").rlike(seeds), "block").otherwise(F.coalesce("verdict", F.lit("allow")))
    urls = judged.select("host", "path", example.alias("example")).distinct()
    texts = urls.groupBy(_model_text().alias("text")).agg(*[F.count(F.when(F.col("example") == v, 1)).alias(v) for v in ("allow", "block")])
    host = F.substring_index("text", "/", 1)
    texts = texts.select(F.monotonically_increasing_id().alias("id"), "*", (F.crc32(host.cast("binary")) % 5 == 0).alias("aside"))
    texts = keep(texts, "url-texts")
    aside = texts.filter("aside")
    counts = keep(gram_counts(texts.filter("not aside")), "url-grams")
    levels, base = gram_levels(_also(counts, aside))
    threshold, shares = best_cut(_text_ratios(aside, levels[-1]).join(aside, "id").select("ratio", "allow", "block"))
    release(texts)
    return UrlTables(counts, levels, base, threshold, shares)


def _also(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """``counts`` with the grams of other texts, which count 0."""
    zero = F.lit(0).cast("long")
    return counts.unionByName(gram_counts(texts.select("text", zero.alias("allow"), zero.alias("block"))))


def judge_urls(pages: DataFrame, model: UrlTables, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (the models' mean log ratio) for each row of ``pages``.

    A null URL, or one without ``://``, has empty host and path, fits no rule and is judged by the models like any
    other. Other columns are ignored; repeated rows are judged alike. A URL may be of any length.
    """
    text_batches(pages.sparkSession)
    ruled = with_rules(pages, rules).withColumn("text", _model_text())
    texts = keep(ruled.select("text").distinct().select(F.monotonically_increasing_id().alias("id"), "text"), "url-texts")
    levels, _ = gram_levels(_also(model.counts, texts))
    ratios = keep(_text_ratios(texts, levels[-1]).join(texts, "id").select("text", "ratio"), "url-ratios")
    release(texts, *levels)
    verdict = F.coalesce("verdict", F.when(F.col("ratio") >= model.threshold, "allow").otherwise("block"))
    return ruled.join(ratios, "text").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")

"""Error rates and evaluation figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import _c, cer, manifest_text, normalized_distance, strip, tokens, wer, word_distance


def error_rates(rows: DataFrame, reference: str, hypothesis: str, group: str) -> DataFrame:
    """Micro-averaged character and word error rates for each group and (null) for all, four places."""
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    own = rows.select(F.col(group).alias(group), F.levenshtein(r, h).alias("_ce"), F.length(r).alias("_cn"), F.length(h).alias("_ch"), word_distance(r, h).alias("_we"), F.size(tokens(r)).alias("_wn"), F.size(tokens(h)).alias("_wh"))
    rate = lambda e, n, m: F.bround(F.when(F.sum(n) == 0, F.when(F.sum(m) == 0, 0.0).otherwise(1.0)).otherwise(F.sum(e) / F.sum(n)), 4)
    out = own.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_ce").alias("char_edits"), F.sum("_cn").alias("chars"), rate("_ce", "_cn", "_ch").alias("cer"), rate("_we", "_wn", "_wh").alias("wer"), F.grouping(group).cast("int").alias("is_total"))
    return out


def subset_summary(rows: DataFrame, reference: str, hypothesis: str, subset: str) -> DataFrame:
    """Macro rates, exact, empty and Latin counts, distinct predictions, and the most frequent one (ties: the first by text)."""
    counts = rows.groupBy(subset, F.col(hypothesis).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy(subset).agg(F.min_by(F.struct("_p", "_n"), F.struct((-F.col("_n")).alias("n"), "_p")).alias("m"))
    out = rows.groupBy(subset).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(cer(reference, hypothesis)).alias("mean_cer"),
        F.avg(wer(reference, hypothesis)).alias("mean_wer"),
        F.count_if(F.col(reference) == F.col(hypothesis)).alias("n_exact"),
        F.count_if(F.trim(hypothesis) == "").alias("n_empty"),
        F.count_if(F.col(hypothesis).rlike("[A-Za-z]") & ~F.col(reference).rlike("[A-Za-z]")).alias("n_latin"),
        F.count_distinct(hypothesis).alias("n_distinct"),
    )
    return out.join(mode, subset).select(*out.columns, F.col("m._p").alias("mode_text"), F.col("m._n").alias("mode_count"))


def _align(r: str, h: str) -> list[tuple[str, str]]:
    """Pairs of an optimal alignment; '' stands for a gap. Matches and substitutions go before deletions before insertions."""
    n, m = len(r), len(h)
    cost = [[*range(m + 1)]] + [[i] + [0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            i, j = i - 1, j - 1
            out.append((r[i], h[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((r[i], ""))
        else:
            j -= 1
            out.append(("", h[j]))
    return out[::-1]


def confusions(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Aligned character pairs by count, summed within each batch before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pairs = [p for r, h in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) for p in _align(r or "", h or "")]
            if pairs:
                yield pd.DataFrame(pairs, columns=["ref", "hyp"]).value_counts().reset_index(name="n")

    return rows.select(reference, hypothesis).mapInPandas(run, "ref string, hyp string, n long").groupBy("ref", "hyp").agg(F.sum("n").alias("n"))


def class_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy for each class of reference character, from confusions()."""
    kind = F.when(F.col("ref") == "್", "virama").when(F.col("ref").rlike("^[ಾ-ೌೕೖ]$"), "vowel_sign").when(F.col("ref").rlike(r"^\p{N}$"), "number").when(F.col("ref").rlike(r"^\p{L}$"), "letter").otherwise("other")
    return pairs.where("ref != ''").groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("ref") == F.col("hyp"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def outcome(expected: Column | str, predicted: Column | str, matches: Column, grounded: Column | None = None) -> Column:
    """CORRECT, INCORRECT, MISSING, ADDITIONAL_GROUNDED or FALSE_POSITIVE."""
    e, p = _c(expected), _c(predicted)
    extra = F.when(F.lit(False) if grounded is None else grounded, "ADDITIONAL_GROUNDED").otherwise("FALSE_POSITIVE")
    return F.when(e.isNull(), extra).when(p.isNull(), "MISSING").when(matches, "CORRECT").otherwise("INCORRECT")


def extraction_scores(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """Precision, recall, F1, accuracy and rate of false positives; 0 where there is nothing to count."""
    n = lambda *o: F.count_if(F.col(column).isin(*o)).cast("double")
    right, wrong, missing, false = n("CORRECT"), n("INCORRECT"), n("MISSING"), n("FALSE_POSITIVE")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(right, right + wrong + false), ratio(right, right + wrong + missing)
    return outcomes.agg(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(right, right + wrong + missing).alias("accuracy"), ratio(false, right + wrong + false).alias("false_positive_rate"))


def benchmark(cases: DataFrame) -> DataFrame:
    """Cases (reference, hypothesis, n_fields, n_correct, is_degraded, is_gis_mismatch, found_mismatch, is_duplicate, found_duplicate, seconds)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    accuracy = lambda when: ratio(F.sum(F.when(when, F.col("n_correct"))), F.sum(F.when(when, F.col("n_fields"))))
    return cases.agg(
        F.avg(cer("reference", "hypothesis")).alias("cer"),
        F.avg(wer("reference", "hypothesis")).alias("wer"),
        accuracy(~F.col("is_degraded")).alias("clean_accuracy"),
        accuracy(F.col("is_degraded")).alias("degraded_accuracy"),
        ratio(F.count_if(F.col("is_gis_mismatch") & F.col("found_mismatch")), F.count_if("is_gis_mismatch")).alias("mismatch_recall"),
        ratio(F.count_if(F.col("is_duplicate") & F.col("found_duplicate")), F.count_if("is_duplicate")).alias("duplicate_recall"),
        F.avg("seconds").alias("mean_seconds"),
        ratio(F.count(F.lit(1)) * 3600, F.sum("seconds")).alias("documents_per_hour"),
    )


def variant_consensus(rows: DataFrame, key: str, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Readings (variant, text, probability) pooled by text: share of variants, mean and largest probability, weighted; the best first."""
    total = rows.groupBy(key).agg(F.count_distinct("variant").alias("_v"))
    own = rows.groupBy(key, "text").agg(F.count_distinct("variant").alias("n_variants"), F.avg("probability").alias("mean_p"), F.max("probability").alias("max_p"))
    a, b, c = weights
    out = own.join(total, key).withColumn("agreement", F.col("n_variants") / F.col("_v")).drop("_v")
    out = out.withColumn("score", a * F.col("agreement") + b * F.col("mean_p") + c * F.col("max_p"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "text")))


def engine_consensus(candidates: Column | str, threshold: float = 0.20) -> Column:
    """Candidates (array of struct(text, confidence)): struct(text, confidence, disagreement); a large disagreement lowers the confidence."""
    c = _c(candidates)
    pairs = F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: normalized_distance(x["text"], y["text"]))))
    most = F.coalesce(F.array_max(pairs), F.lit(0.0))
    best = F.aggregate(c, F.get(c, F.lit(0)), lambda s, x: F.when(x["confidence"] > s["confidence"], x).otherwise(s))
    return F.struct(best["text"].alias("text"), F.when(most >= threshold, best["confidence"] * (1 - most)).otherwise(best["confidence"]).alias("confidence"), most.alias("disagreement"))


def rescored(rows: DataFrame, key: str, margin: float = 0.04) -> DataFrame:
    """Candidates (candidate_no, score) ranked, with softmax and whether the lead over the next is under margin."""
    w = Window.partitionBy(key)
    o = w.orderBy(F.desc("score"), "candidate_no")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return rows.withColumns({"rank": F.row_number().over(o), "softmax": e / F.sum(e).over(w), "lead": F.col("score") - F.lead("score").over(o)}).withColumn("needs_review", F.coalesce(F.col("lead") < margin, F.lit(False)))


def orthographic_score(text: Column | str) -> Column:
    """1 less a share for each illegal sequence of Kannada signs, at least 0; 0 for an empty text and 0.5 for one without Kannada letters."""
    t = F.coalesce(_c(text), F.lit(""))
    less = lambda pattern, share: F.when(t.rlike(pattern), share).otherwise(0.0)
    # fixed values: a sign or virama at the start, two signs in a row, a sign after a virama, two viramas
    lost = less("^[ಾ-ೄೆ-ೈೊ-್]", 0.5) + less("[ಾ-ೌ]{2}", 0.4) + less("್[ಾ-ೌ]", 0.4) + less("್್", 0.5)
    return F.when(t == "", 0.0).when(~t.rlike("[ಀ-೿]"), 0.5).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - lost, 4)))


def rescored_best(rows: DataFrame, lexicon: DataFrame, key: str, entry: str = "entry", weights: tuple[float, float, float] = (0.50, 0.35, 0.15), margin: float = 0.08) -> DataFrame:
    """Candidates (candidate_no, text, score) of each key weighed by model, lexicon and orthography; one row for each key.

    The first candidate stays unless the best one leads by margin, or has an entry of the lexicon (0.95 or more) and sound
    orthography (0.90 or more) and any lead. needs_review: a composite below 0.65, or a lead of the best below 0.04.
    """
    model, words, signs = weights
    o = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(o))
    own = rows.select(key, "candidate_no", manifest_text("text").alias("text"), "score").withColumn("p", e / F.sum(e).over(o))
    known = lexicon_matches(own.where("text != ''").select(F.col("text").alias("word")), lexicon, entry=entry).select(F.col("word").alias("text"), "similarity")
    full = own.join(known, "text", "left").withColumns({"similarity": F.round(F.coalesce("similarity", F.lit(0.0)), 4), "signs": orthographic_score("text")})
    full = full.withColumn("composite", F.round(model * F.col("p") + words * F.coalesce("similarity", F.lit(0.0)) + signs * F.col("signs"), 4))
    row = F.struct("candidate_no", "text", "similarity", "signs", "composite")
    by = full.groupBy(key).agg(F.min_by(row, "candidate_no").alias("first"), F.sort_array(F.collect_list(F.struct((-F.col("composite")).alias("c"), "candidate_no", row.alias("r")))).alias("all"))
    best, second = F.col("all")[0]["r"], F.get("all", F.lit(1))["r"]
    lead = best["composite"] - F.col("first.composite")
    strong = (best["similarity"] >= 0.95) & (lead > 0) & (best["signs"] >= 0.90)
    switched = (best["candidate_no"] != F.col("first.candidate_no")) & ((F.round(lead, 4) >= margin) | strong)
    final = F.when(switched, best).otherwise(F.col("first"))
    close = F.coalesce(F.round(best["composite"] - second["composite"], 4) < 0.04, F.lit(False))
    return by.select(key, final["text"].alias("text"), final["composite"].alias("confidence"), switched.alias("is_switched"), ((final["composite"] < 0.65) | close).alias("needs_review"))


def lexicon_matches(words: DataFrame, lexicon: DataFrame, word: str = "word", entry: str = "entry", least: float = 0.70, around: int = 2) -> DataFrame:
    """Each word's most similar entry within around letters of its length; lengths are the equi key. Ties: the smaller entry."""
    a = words.select(word).distinct().withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.length(word) - around), F.length(word) + around)))
    pairs = a.join(lexicon.select(entry, F.length(entry).alias("n")), "n").withColumn("similarity", 1 - normalized_distance(word, entry)).where(F.col("similarity") >= least)
    return pairs.groupBy(word).agg(F.min_by(F.struct(entry, "similarity"), F.struct((-F.col("similarity")).alias("s"), entry)).alias("m")).select(word, "m.*")


def suggestions(text: Column | str, lexicon: list[str], most: int = 2) -> Column:
    """The terms, in their order, that stand in the stripped text or are within one edit of it (most edits from five letters)."""
    t = strip(text)
    near = [F.when((t != "") & (F.contains(t, F.lit(w)) | (F.levenshtein(t, F.lit(w)) <= (1 if len(w) <= 4 else most))), F.lit(w)) for w in dict.fromkeys(lexicon)]
    return F.array_compact(F.array(*near))

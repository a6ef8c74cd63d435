"""The experiment from files to motifs, and its models on new sequences.

Each step is a function of DataFrames; ``fit_all`` and ``predict_all`` join
them and keep what they make in a folder, so that a step that was done with
the same parameters is read, not made again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.stats import bh_threshold
from kmerloom.operators import decay, enrichment, kmers, lasso, motifs, peaks, regression, spikes
from kmerloom.operators.motifs import Motif, MotifOptions
from kmerloom.sources import kmer_store, tables
from kmerloom.sources.kmer_store import KmerStore
from kmerloom.sources.tables import memoised, stage

KS = range(3, 8)
MAX_KMERS = 12_000
#: Letters below which new sequences are left out, and reporters' lengths outside of which rates are corrected for length.
MIN_LENGTH, USUAL_LENGTHS = 50, (100, 120)


@dataclass
class Rates:
    """Fitted decay of one series of samples."""

    normalised: DataFrame
    fits: DataFrame
    noise: DataFrame
    floor: float
    rejected_at: float


def calibrate(counted: DataFrame, spiked: DataFrame, fraction: float = 0.001) -> DataFrame:
    """Counts (``id``, ``tm``, ``cnt``) on the log2 scale, calibrated by spikes (``rank``, ``tm``, ``q``)."""
    found = stage(spikes.drop_outliers(spiked))
    dealt = stage(spikes.redistribute(found, spikes.usable_columns(counted, found)))
    course = spikes.smooth_totals(counted, spikes.scale_fraction(counted, dealt, fraction))
    return spikes.normalise(counted, spikes.regression_calibration(counted, stage(spikes.cap(counted, course))))


def fit_rates(counted: DataFrame, spiked: DataFrame | None = None, reporters: DataFrame | None = None) -> Rates:
    """Decay of every reporter of one series; without spikes counts are taken as they are.

    ``reporters`` (``id``) takes the place of the series' own selection.
    ``fits`` has a row for every id counted: ``a``, ``b``, ``t``, ``r``,
    ``chi2`` and ``p`` are null for those that were not fitted.
    """
    counted = stage(counted.select("id", "tm", F.col("cnt").cast("double").alias("cnt")))
    if spiked is None:
        logs = counted.where("cnt > 0").select("id", "tm", "cnt", F.log2("cnt").alias("log_x"))
    else:
        logs = stage(calibrate(counted, spiked))
    times = decay.usable_times(counted)
    reporters = decay.select_reporters(counted, times) if reporters is None else reporters
    data = stage(logs.where("log_x is not null").join(F.broadcast(times), "tm").join(reporters.select("id"), "id"))  # a row a time
    floor = decay.detection_floor(logs).first()[0]
    floor = decay.LOWEST if floor is None else floor
    noise = stage(decay.column_noise(data))
    fitted = stage(decay.fit(data, noise, floor))
    tested = stage(decay.goodness_of_fit(data, fitted, noise, floor))
    ids = counted.select("id").distinct()
    fits = ids.join(fitted.join(tested, "id", "left"), "id", "left")
    return Rates(logs, fits, noise, floor, bh_threshold(tested, "p").first()[0])


def common_reporters(counted: DataFrame, series: dict[str, Sequence[float]]) -> DataFrame:
    """``id`` of the reporters whose counts are high enough in each of the series."""
    every = None
    for times in series.values():
        own = counted.where(F.col("tm").isin([float(t) for t in times]))
        chosen = decay.select_reporters(own, decay.usable_times(own)).select("id")
        every = chosen if every is None else every.unionAll(chosen)
    return every.groupBy("id").count().where(F.col("count") == len(series)).select("id")


def fit_series(counted: DataFrame, spiked: DataFrame | None, series: dict[str, Sequence[float]]) -> dict[str, Rates]:
    """``fit_rates`` of several series of samples, each by its times, for the reporters that are good in all of them; ``tm`` tells samples apart."""
    if not series:
        return {}
    reporters = stage(common_reporters(counted, series))
    out = {}
    for name, times in series.items():
        own = F.col("tm").isin([float(t) for t in times])
        out[name] = fit_rates(counted.where(own), None if spiked is None else spiked.where(own), reporters)
    return out


def ranked_spikes(counted: DataFrame) -> DataFrame:
    """``rank``, ``tm``, ``q`` of the rows of a count table that are spikes, in the order of their names."""
    found = counted.where("is_spike")
    names = sorted(r["id"] for r in found.select("id").distinct().collect())  # five of them
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("id")) - 1 if names else F.lit(0)
    return found.select(rank.cast("int").alias("rank"), "tm", F.col("cnt").cast("double").alias("q"))


def _words(seqs: DataFrame, ids: DataFrame, ks: Sequence[int], store: KmerStore | None) -> DataFrame:
    """Counts of the words of ``ids``, from the store if there is one, which has to hold each of them once."""
    if store is None:
        return kmers.counts(seqs.join(ids.select("id"), "id", "left_semi"), list(ks))
    counted, bad = store.stack(list(ks), ids)
    if bad:
        raise ValueError(f"sequences that the store lacks or holds twice, by k: {bad}")
    return counted


def features(seqs: DataFrame, targets: DataFrame, ks: Sequence[int] = KS, max_kmers: int = MAX_KMERS, store: KmerStore | None = None) -> tuple[list[str], DataFrame]:
    """The k-mers to learn from, and design rows: those in two sequences or more, and of too many the most enriched or depleted.

    Targets without a sequence take no part.  Words are counted unless a store holds them.
    """
    known = targets.select("id", "d").where("d is not null")
    rows = stage(known.join(seqs.where("seq is not null").select("id").distinct(), "id", "left_semi"))
    counted = stage(_words(seqs, rows, ks, store))
    chosen = kmers.presence(counted).select("kmer")
    if chosen.count() > max_kmers:
        members = counted.join(chosen, "kmer", "left_semi").select("id", "kmer")
        tested = enrichment.both_tails(members, rows.select("id", F.col("d").alias("s")))
        chosen = kmers.preselect(tested, max_kmers).select("kmer")
    names = sorted(r["kmer"] for r in chosen.collect())
    return names, stage(regression.design(counted, rows, names))


@dataclass
class RateModel:
    """Weights of k-mers (``kmer``, ``k``, ``weight``, ``share``), the intercept and the fitted targets."""

    model: DataFrame
    intercept: float
    fitted: DataFrame
    held_out: DataFrame


def fit_regression(fits: DataFrame, seqs: DataFrame, ks: Sequence[int] = KS, max_kmers: int = MAX_KMERS, onset: bool = False, penalties: int = 100, store: KmerStore | None = None) -> RateModel:
    """Rates (or onsets) by k-mers: the lasso chooses, least squares fit again, ten folds check.

    Fits without a sequence are left out before the best ones are chosen.
    With a store its words are read instead of counted.
    """
    # the percentiles of the selection take many passes, and only its sequences are read from then on
    with_sequence = stage(fits.join(seqs.where("seq is not null").select("id"), "id", "left_semi"))
    chosen = stage(regression.select_rows(with_sequence, onset))
    seqs = stage(seqs.join(chosen.select("id"), "id", "left_semi"))
    names, rows = features(seqs, chosen, ks, max_kmers, store)
    path = lasso.lasso_rows(rows, len(names), penalties)
    kept = [names[i] for i in np.flatnonzero(path.coefficients[path.chosen()])]
    counted = _words(seqs, chosen, sorted({len(k) for k in kept} or {min(ks)}), store)
    again = stage(regression.design(counted, chosen.select("id", "d"), kept))
    beta, b0, fitted = regression.ols(again, len(kept))
    return RateModel(stage(regression.model_table(kept, beta, seqs.sparkSession)), b0, fitted, regression.cross_validate(again, len(kept)))


@dataclass
class PeakModel:
    """What calls peaks on new sequences: the largest weight, the threshold and the motifs; ``peaks`` are the reporters' own."""

    top: float
    least: float
    motifs: list[Motif]
    peaks: DataFrame


def _seed_motifs(found: DataFrame, sign: int, options: MotifOptions) -> list[Motif]:
    """Motifs of the groups that the seeds of a cover make; ``found`` has a sequence once."""
    own = motifs.members_of(found, sign)
    if isinstance(own, motifs.Members):
        return motifs.seed_motifs_in_memory(own, sign, options)
    covered = stage(motifs.seed_cover(own, options.seed_lengths).withColumnRenamed("seed", "motif"))
    groups = motifs.group_stats(covered).withColumnRenamed("motif", "consensus")
    heavy = [r["consensus"] for r in motifs.heavy_motifs(groups, options.min_weight_share).collect()]
    rows: dict[str, list] = {}
    for r in motifs.seed_profiles(covered.where(F.col("motif").isin(heavy))).collect():
        rows.setdefault(r["motif"], []).append((r["pos"], *(r[x] for x in (*motifs.LETTERS, "gap"))))
    return motifs.named(rows, sign, options)


def fit_peaks(seqs: DataFrame, model: DataFrame, options: MotifOptions = MotifOptions(), refit: bool = True) -> PeakModel:
    """Peaks of the model's weights on its sequences, and the motifs that they share."""
    arrays = stage(kmers.weight_arrays(seqs, model))
    masses = stage(kmers.position_masses(arrays))
    weights, top = peaks.normalised(stage(kmers.norm_weights(arrays, masses)))
    weights = stage(weights)
    least = peaks.threshold(weights, masses=masses) or 0.0
    called = stage(peaks.extract(weights, least, edge=peaks.edges(weights, masses)))
    found = stage(peaks.sequence_totals(called))
    shares = motifs.background(found)
    lightest = options.min_weight_share * (found.agg(F.sum(F.abs("weight"))).first()[0] or 0.0)
    out: list[Motif] = []
    for sign in (1, -1):
        state = _seed_motifs(found, sign, options)
        out += motifs.prune(found, state, shares, sign, options, lightest) if refit else state
    return PeakModel(top, least, out, called)


def predict_rates(seqs: DataFrame, model: DataFrame, intercept: float) -> DataFrame:
    """``id``, ``rate``, ``half_life`` of new sequences; null below ``regression.LOW_LENGTH`` letters.

    Where a sequence is shorter or longer than reporters are, all rates are
    corrected for length and bounded.
    """
    scored = stage(regression.score(seqs, model, intercept))
    low, high = scored.agg(F.min("len"), F.max("len")).first()
    if low is None or (low >= USUAL_LENGTHS[0] and high <= USUAL_LENGTHS[1]):
        rates = scored.select("id", F.col("score").alias("rate"))
    else:
        rates = regression.correct_length(scored, intercept).withColumnRenamed("d", "rate")
    return rates.select("id", "rate", F.try_divide(F.log(F.lit(2.0)), "rate").alias("half_life"))


def predict_peaks(seqs: DataFrame, model: DataFrame, known: PeakModel, background: DataFrame | None = None) -> DataFrame:
    """``id``, ``start``, ``end``, ``weight``, ``seq``, ``motif``, ``llr``: peaks of new sequences and their motifs.

    Weights are shares of the fitted model's largest; they are divided by
    their positions' scales where there are more than ten sequences.
    """
    arrays = stage(kmers.weight_arrays(seqs, model))
    if arrays.limit(11).count() > 10:
        arrays = stage(kmers.norm_weights(arrays))
    weights, _ = peaks.normalised(arrays, known.top)
    called = peaks.extract(weights, known.least)
    return motifs.assign(called, known.motifs, motifs.background(seqs if background is None else background))


def _stored(spark: SparkSession, folder: str, name: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    return memoised(spark, folder, name, parameters, make)


def fit_all(spark: SparkSession, seq_path: str, count_path: str, times: Sequence[float], folder: str, ks: Sequence[int] = KS, max_kmers: int = MAX_KMERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fits, k-mer weights and motif matrices of an experiment's two files; stored under ``folder``, as are the words of the sequences."""
    files = {"seqs": seq_path, "counts": count_path, "times": list(times)}
    seqs = tables.read_sequences(spark, seq_path)
    counted = tables.read_counts(spark, count_path, list(times))

    def rates() -> DataFrame:
        spiked = ranked_spikes(counted)
        return fit_rates(counted.where("not is_spike"), spiked if spiked.limit(1).count() else None).fits

    fits = _stored(spark, folder, "fits", files, rates)
    how = {**files, "ks": list(ks), "max_kmers": max_kmers}

    def weights() -> DataFrame:
        path = tables.stored_path(folder, "kmers", {"seqs": seq_path, "ks": list(ks)})
        known = kmer_store.open_store(spark, path) if kmer_store.exists(spark, path) else kmer_store.save(kmers.counts(seqs, list(ks)), seqs, ks, path)
        m = fit_regression(fits, seqs, ks, max_kmers, store=known)
        return m.model.withColumn("intercept", F.lit(m.intercept))

    model = _stored(spark, folder, "model", how, weights)

    def matrices() -> DataFrame:
        m = fit_peaks(seqs, model)
        rows = [(x.name, x.sign, i + 1, *c) for x in m.motifs for i, c in enumerate(x.columns)]
        out = spark.createDataFrame(rows, "motif string, sign int, pos int, A double, C double, G double, T double")
        return out.withColumn("top", F.lit(m.top)).withColumn("least", F.lit(m.least))

    return fits, model, _stored(spark, folder, "motifs", how, matrices)


def peak_model(matrices: DataFrame) -> PeakModel:
    """A peak model from the table that ``fit_all`` stores."""
    rows = matrices.orderBy("sign", "motif", "pos").collect()
    if not rows:
        return PeakModel(1.0, float("inf"), [], matrices)
    columns: dict[tuple[str, int], list] = {}
    for r in rows:
        columns.setdefault((r["motif"], r["sign"]), []).append((r["A"], r["C"], r["G"], r["T"]))
    return PeakModel(rows[0]["top"], rows[0]["least"], [Motif(name, sign, tuple(c)) for (name, sign), c in columns.items()], matrices)


def predict_all(spark: SparkSession, seq_path: str, background_path: str, model: DataFrame, matrices: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rates and peaks of the sequences of a file, stored under ``folder``."""
    seqs = tables.read_sequences(spark, seq_path, min_length=MIN_LENGTH)
    other = tables.read_sequences(spark, background_path, min_length=MIN_LENGTH)
    files = {"seqs": seq_path, "background": background_path}
    intercept = (model.select("intercept").first() or [0.0])[0]
    rates = _stored(spark, folder, "rates", files, lambda: predict_rates(seqs, model, intercept))
    return rates, _stored(spark, folder, "peaks", files, lambda: predict_peaks(seqs, model, peak_model(matrices), other))

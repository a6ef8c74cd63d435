"""Registry of the domain queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import stats
from kmerloom.operators import decay, enrichment, kmers, lasso, logistic, motifs, peaks, presentation, regression, spikes
from kmerloom.plans import experiment, oracles
from kmerloom.plans import fixtures as fx
from kmerloom.sources import kmer_store, tables
from kmerloom.sources.tables import stage

Query = Callable[[SparkSession, str], DataFrame]
SEED = "TAA"
#: Features of the small regressions: all words of three letters.
WORDS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _counts3(spark, d) -> DataFrame:
    return kmers.counts(fx.sequences(spark, d), 3)


def _scores(spark, d) -> DataFrame:
    """``id``, ``len``, ``raw`` and ``score`` of all sequences."""
    return regression.score(fx.sequences(spark, d), fx.model(spark), fx.B0)


def _scored(spark, d) -> DataFrame:
    """The sequences that are long enough for a score."""
    return _scores(spark, d).where("score is not null")


def _arrays(spark, d) -> DataFrame:
    return kmers.weight_arrays(fx.sequences(spark, d), fx.model(spark))


def _weights(spark, d) -> DataFrame:
    return kmers.long_weights(_arrays(spark, d))


class _Decay:
    """The decay chain on the count fixture: what each step hands to the next."""

    def __init__(self, spark: SparkSession, d: str):
        self.counts = stage(fx.counts(spark, d))
        self.logs = fx.logs(self.counts)
        self.times = decay.usable_times(self.counts)
        self.reporters = decay.select_reporters(self.counts, self.times)
        self.data = stage(self.logs.join(F.broadcast(self.times), "tm").join(self.reporters.select("id"), "id"))

    @cached_property
    def noise(self) -> DataFrame:
        return stage(decay.column_noise(self.data))

    @cached_property
    def floor(self) -> float:
        return decay.detection_floor(self.logs).first()[0]

    @cached_property
    def fits(self) -> DataFrame:
        return stage(decay.fit(self.data, self.noise, self.floor))

    @cached_property
    def tests(self) -> DataFrame:
        return stage(decay.goodness_of_fit(self.data, self.fits, self.noise, self.floor))

    @property
    def tested(self) -> DataFrame:
        return self.fits.join(self.tests, "id")


def _peak_weights(spark, d) -> tuple[DataFrame, DataFrame, float]:
    """Normalised weights, which positions they use, and the largest one before."""
    arrays = stage(_arrays(spark, d))
    masses = stage(kmers.position_masses(arrays))
    weights, top = peaks.normalised(stage(kmers.norm_weights(arrays, masses)))
    return stage(weights), masses, top


def _peaks(spark, d, signs: tuple[int, ...] = (1, -1)) -> DataFrame:
    weights, masses, _ = _peak_weights(spark, d)
    return peaks.extract(weights, peaks.threshold(weights, masses=masses), edge=peaks.edges(weights, masses), signs=signs)


def _assigned(spark, d) -> DataFrame:
    return motifs.assign(_peaks(spark, d), fx.MOTIFS, fx.BACKGROUND)


def _seed_peaks(spark, d) -> DataFrame:
    """The distinct positive peaks, written once: an alignment takes their edges before it reads them."""
    return stage(_peaks(spark, d).where(F.col("weight") > 0).groupBy("seq").agg(F.max("weight").alias("weight")))


def kmer_table_function(spark, d):
    """Counts of words of three letters through SQL."""
    kmers.register_table_function(spark)
    return spark.sql("SELECT id, kmer, 3 AS k, cnt FROM {seqs}, LATERAL kmers(seq, 3)", seqs=fx.sequences(spark, d))


def kmer_counts_k3_7(spark, d):
    return kmers.totals(fx.sequences(spark, d), range(3, 8))


def _store(spark, d, ks=(3, 4, 5)) -> kmer_store.KmerStore:
    """A new store of the words of all documents."""
    seqs = fx.sequences(spark, d)
    return kmer_store.save(kmers.counts(seqs, list(ks)), seqs, ks, tables.work_dir(spark), buckets=8)


def kmer_store_stack(spark, d):
    """Words of three and five letters per document, read from a store that also holds those of four; ids come from the labels."""
    found, bad = _store(spark, d).stack((3, 5), fx.quality(spark, d))
    if bad:
        raise ValueError(f"documents without words: {bad}")
    return found.groupBy("id").agg(F.count("*").alias("words"), F.sum("cnt").alias("total"), F.max("k").alias("longest"))


def kmer_store_filled(spark, d):
    """Words of four letters by part number, from the document of that number; numbers without a document count 0."""
    ids = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    found = _store(spark, d).filled((4,), ids)
    return found.groupBy("id").agg(F.count("kmer").alias("words"), F.sum("cnt").alias("total"))


def kmer_lexicon(spark, d):
    """All words of five letters, with the documents that hold them."""
    found = kmers.totals(fx.sequences(spark, d), 5).drop("k")
    return kmers.lexicon(spark, 5).join(found, "kmer", "left").fillna(0)


def kmer_norm_weights(spark, d):
    # many values end in the middle of two roundings, which this form decides alike everywhere
    w = F.floor(F.col("w") * 1e10 + 0.5) / F.lit(1e10)
    return kmers.long_weights(kmers.norm_weights(stage(_arrays(spark, d)))).withColumn("w", w)


def kmer_preselect_rank(spark, d):
    """The words most enriched or depleted in good documents."""
    tested = enrichment.hypergeometric(_members(spark, d), fx.quality(spark, d)).where("value = 1")
    return kmers.preselect(_rounded(tested, 9, "p_right", "p_left").select("kmer", "p_right", "p_left"), 20)


def weight_topn(spark, d):
    """The words that add most to the scores of all documents together."""
    total = kmers.totals(fx.sequences(spark, d), 3).join(fx.model(spark).drop("k"), "kmer")
    return presentation.top_weights(total.select("kmer", "k", (F.col("weight") * F.col("total")).alias("weight")), 15)


def sequence_score(spark, d):
    rate = decay.clamp_rate(F.col("score"))
    return _scores(spark, d).select("id", "score", rate.alias("rate"), F.round(decay.half_life(rate), 6).alias("half_life"))


def sequence_length_filter(spark, d):
    return tables.long_enough(fx.sequences(spark, d), 50).select("id", F.length("seq").cast("long").alias("len"))


def length_slope_gate(spark, d):
    rows = _scored(spark, d).select("len", (F.col("score") + 40).alias("d"))
    return _rounded(regression.length_slope(rows), 6, "slope", "intercept")


def rate_bounds(spark, d):
    return _scores(spark, d).select("id", F.round(decay.clamp_rate(F.col("score")), 6).alias("rate"))


def half_life(spark, d):
    return _scores(spark, d).select("id", F.round(decay.half_life(decay.clamp_rate(F.col("score"))), 6).alias("half_life"))


def counts_unpivot(spark, d):
    times = [float(t) for t in range(7)]
    wide = fx.counts(spark, d).groupBy("id").pivot("tm", times).agg(F.first("cnt")).fillna(0)
    return tables.unpivot(wide.toDF("id", *[f"t{i}" for i in range(7)]), times)


def spike_split(spark, d):
    counted = fx.counts(spark, d)
    both = counted.select(F.concat(F.lit("P"), "id").alias("id"), "tm", "cnt").union(
        fx.spikes(counted).select(F.concat(F.lit(tables.SPIKE_PREFIX), "rank"), "tm", "q")
    )
    return tables.split_spikes(both).groupBy("is_spike", "tm").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))


def spike_outliers(spark, d):
    q = F.when((F.col("rank") == 2) & (F.col("tm") == 3), 5.0).otherwise(F.col("q"))
    return spikes.drop_outliers(fx.spikes(fx.counts(spark, d)).withColumn("q", q)).select("rank", "tm", "q")


def _spike_chain(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    counted = fx.counts(spark, d)
    found = fx.spikes(counted)
    columns = spikes.usable_columns(counted, found)
    return counted, columns, spikes.redistribute(found, columns)


def spike_usable_columns(spark, d):
    return _spike_chain(spark, d)[1]


def spike_redistribute(spark, d):
    return _rounded(_spike_chain(spark, d)[2].select("rank", "tm", "q"), 6, "q")


def spike_scale(spark, d):
    counted, _, dealt = _spike_chain(spark, d)
    return spikes.scale_fraction(counted, dealt).select("rank", "tm", "q")


def spike_course(spark, d):
    counted, _, dealt = _spike_chain(spark, d)
    return spikes.cap(counted, spikes.smooth_totals(counted, spikes.scale_fraction(counted, dealt, 0.05)))


def count_calibration_apply(spark, d):
    counted = fx.counts(spark, d)
    return _rounded(spikes.normalise(counted, spikes.mean_calibration(fx.spikes(counted))), 6, "log_x")


def count_calibration_regression(spark, d):
    counted = fx.counts(spark, d)
    return spikes.normalise(counted, spikes.regression_calibration(counted, fx.spikes(counted)))


def sample_share_neighbors(spark, d):
    return _rounded(decay.shares(fx.counts(spark, d)), 9, "share", "near")


def two_phase_eval(spark, d):
    c = _Decay(spark, d)
    rows = c.fits.join(F.broadcast(c.times))  # a row a time
    y = decay.predict_two_phase(F.col("tm"), F.col("a"), F.col("a") / 2, F.col("b"), F.lit(3))
    return rows.select("id", "tm", F.round(y, 6).alias("y"))


def decay_predict(spark, d):
    c = _Decay(spark, d)
    y = decay.predict(F.col("tm"), F.col("a"), F.col("b"), F.col("t"), c.floor)
    return c.data.select("id", "tm").join(c.fits, "id").select("id", "tm", F.round(y, 6).alias("y_hat"))


def decay_wls(spark, d):
    c = _Decay(spark, d)
    t0 = c.data.agg(F.min("tm").alias("t0"))
    rows = c.data.join(F.broadcast(c.noise), "tm").join(F.broadcast(t0))
    w = F.when(F.col("log_x") <= c.floor, 0.0).otherwise(1 / F.col("sd"))
    points = rows.select("id", (F.col("tm") - F.col("t0")).alias("x"), F.col("log_x").alias("y"), w.alias("w"))
    return _rounded(decay.weighted_line(points), 6, "a", "b")


def bh_fdr(spark, d):
    return _rounded(stats.bh_threshold(_Decay(spark, d).tests.select(F.round("p", 9).alias("p")), "p"), 9, "threshold")


def rate_phase_log(spark, d):
    fits = _Decay(spark, d).fits.select("id", (F.col("t") + F.col("id") % 12).alias("t"), F.col("a").alias("a1"), (F.col("a") / 2).alias("a2"))
    return _rounded(decay.phase_rates(fits), 6, "log_d1", "log_d10", "log_h1", "log_h10")


def logistic_eval(spark, d):
    y = logistic.evaluate(F.lit(0.25), F.lit(0.5), F.col("cnt"), F.lit(3.0), F.col("tm"))
    return fx.counts(spark, d).select("id", "tm", F.round(y, 6).alias("y"))


def logistic_series(spark, d):
    rows = fx.logs(fx.counts(spark, d)).groupBy((F.col("id") % 10).alias("series"), F.col("tm").alias("x")).agg(F.avg("log_x").alias("y"))
    return logistic.fit_series(rows, [0, -20, -20, 0], [5, 20, 20, 24])


def threshold_classifier(spark, d):
    pairs = _scored(spark, d).join(fx.lengths(spark, d), "id").select(F.col("score").alias("pred"), F.col("s").alias("d"))
    return regression.best_threshold(pairs, 2000)


def _design(spark, d) -> DataFrame:
    targets = fx.lengths(spark, d).select("id", (F.col("s") / 1024).alias("d"))
    return regression.design(_counts3(spark, d), targets, WORDS)


def gram_matrix(spark, d):
    """Sums of products of the counts of all words of three letters, as the regressions use them."""
    xx = regression.total(regression.gram(_design(spark, d), len(WORDS))).xx[:-1, :-1]
    found = [(WORDS[i], WORDS[j], float(xx[i, j])) for i, j in zip(*xx.nonzero(), strict=True)]
    return spark.createDataFrame(found, "x string, y string, v double")


def ols_predict(spark, d):
    return regression.ols(stage(_design(spark, d)), len(WORDS))[2]


def cv_fold_predict(spark, d):
    return regression.cross_validate(stage(_design(spark, d)), len(WORDS))


def _targets(spark, d) -> DataFrame:
    """Fits of documents as if they were reporters: the target is their length."""
    return fx.lengths(spark, d).select("id", (F.col("s") / 1024).alias("d"))


def lasso_path(spark, d):
    features, rows = experiment.features(fx.sequences(spark, d), _targets(spark, d), range(3, 6))
    path = lasso.lasso_rows(rows, len(features))
    found = [
        (i, float(lam), features[k], float(path.coefficients[i, k]), float(path.mse[i]), float(path.se[i]), i == path.chosen())
        for i, lam in enumerate(path.penalties)
        for k in path.coefficients[i].nonzero()[0]
    ]
    return spark.createDataFrame(found, "lambda_idx int, lambda double, kmer string, coef double, mse double, se double, chosen boolean")


def length_correction(spark, d):
    return regression.correct_length(_scores(spark, d), fx.B0)


def peak_threshold(spark, d):
    weights, masses, top = _peak_weights(spark, d)
    level = peaks.threshold(weights, masses=masses)
    return spark.range(1).select(F.round(F.lit(level), 6).alias("threshold"), F.round(F.lit(top), 6).alias("largest"))


def _runs(sign: int) -> Query:
    return lambda spark, d: _rounded(_peaks(spark, d, (sign,)), 6, "weight")


def peak_sequence_totals(spark, d):
    # millionths are whole numbers, whose sums have no rounding
    whole = _peaks(spark, d).withColumn("weight", F.round(F.col("weight") * 1e6).cast("long"))
    return peaks.sequence_totals(whole).select("seq", (F.col("weight") / F.lit(1e6)).alias("weight"))


def pwm_scan(spark, d):
    seqs = fx.sequences(spark, d).where(F.length("seq") > 0)
    return _rounded(motifs.scan(seqs, fx.MOTIFS), 9, "score").withColumn("position", F.col("position").cast("long"))


def motif_filter(spark, d):
    groups = motifs.group_stats(_assigned(spark, d)).withColumnRenamed("motif", "consensus")
    return _rounded(motifs.heavy_motifs(groups, 0.25), 5, "weight")


def pwm_build_from_alignment(spark, d):
    out = motifs.from_alignment(motifs.seed_alignment(_seed_peaks(spark, d), SEED))
    return _rounded(out, 6, "A", "C", "G", "T", "information")


def seed_cover(spark, d):
    return motifs.seed_cover(_peaks(spark, d).where(F.col("weight") > 0))


def _motif_rows(spark, found: list) -> DataFrame:
    rows = [(m.name, m.sign, i + 1, *c) for m in found for i, c in enumerate(m.columns)]
    return spark.createDataFrame(rows, "motif string, sign int, pos int, A double, C double, G double, T double")


def _peak_totals(spark, d) -> tuple[DataFrame, list[float]]:
    """Distinct peaks with their weights, and their letters' shares."""
    found = stage(peaks.sequence_totals(_peaks(spark, d)))
    return found, motifs.background(found)


def motif_em(spark, d):
    found, shares = _peak_totals(spark, d)
    return _motif_rows(spark, [m for sign in (1, -1) for m in motifs.refine(found, fx.MOTIFS, shares, sign)[0]])


def motif_prune(spark, d):
    found, shares = _peak_totals(spark, d)
    least = motifs.MotifOptions().min_weight_share * (found.agg(F.sum(F.abs("weight"))).first()[0] or 0.0)
    return _motif_rows(spark, [m for sign in (1, -1) for m in motifs.prune(found, fx.MOTIFS, shares, sign, min_weight=least)])


def motif_background(spark, d):
    """Shares of the letters in all peaks."""
    shares = motifs.background(_peaks(spark, d))
    return spark.createDataFrame(list(zip(motifs.LETTERS, [round(x, 9) for x in shares], strict=True)), "letter string, share double")


def motif_threshold(spark, d):
    points = _assigned(spark, d).select(F.col("llr").alias("x"), (F.col("weight") > 0).alias("hit"), F.lit(1.0).alias("weight"))
    return _rounded(motifs.least_error_threshold(points), 6, "threshold")


def motif_logo(spark, d):
    matrix = motifs.from_alignment(motifs.seed_alignment(_seed_peaks(spark, d), SEED))
    return presentation.logo(matrix, 100)


def confusion_matrix(spark, d):
    pairs = _scored(spark, d).join(fx.lengths(spark, d), "id").select(F.col("score").alias("pred"), F.col("s").alias("d"))
    return presentation.confusion(pairs, -8.0, 2000)


def fit_quality(spark, d):
    pairs = _scored(spark, d).join(fx.lengths(spark, d), "id").select(F.col("score").alias("pred"), F.col("s").alias("d"))
    return _rounded(presentation.fit_quality(pairs), 6, "r")


def kmer_list_parse(spark, d):
    per = _counts3(spark, d).groupBy("kmer").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("i"), F.col("cnt").cast("string").alias("c"))).alias("x"))
    joined = [F.array_join(F.col("x")[f], ",") for f in ("i", "c")]
    return tables.parse_kmer_list(per.select(F.concat_ws("\t", "kmer", F.size("x").cast("string"), *joined).alias("value")))


def weight_track(spark, d):
    scores = _scored(spark, d)
    rate: Column = decay.clamp_rate(F.col("score"))
    tracks = presentation.weight_tracks(_weights(spark, d), scores.select("id", rate.alias("score"))).drop("score")
    return _rounded(tracks.join(scores.select("id", "score"), "id"), 6, "half_life_minutes")


def fit_rates(spark, d):
    """Decay of all ids counted, without spikes."""
    return _rounded(experiment.fit_rates(fx.counts(spark, d)).fits.select("id", "a", "b", "t", "r"), 6, "a", "b", "r")


def fit_rates_spiked(spark, d):
    counted = stage(fx.counts(spark, d))
    return experiment.fit_rates(counted, fx.spikes(counted)).fits


def _series(spark, d) -> DataFrame:
    found = experiment.fit_series(stage(fx.counts(spark, d)), None, fx.SERIES)
    parts = [r.fits.select(F.lit(name).alias("series"), "id", "a", "b", "t", "r", "p") for name, r in found.items()]
    return parts[0].unionByName(parts[1])


def fit_series(spark, d):
    """Decay by two series of samples, of the parts that are counted often enough in both."""
    return _rounded(_series(spark, d).drop("p"), 6, "a", "b", "r")


def fit_series_tests(spark, d):
    """The goodness of the fits of both series."""
    return _series(spark, d).select("series", "id", "p")


def linear_fit_basic(spark, d):
    """Lengths by three counts of which one is the sum of the others: any basic solution predicts the same."""
    words = _counts3(spark, d).where(F.col("kmer").isin("TAA", "CAC"))
    n = words.groupBy("id").pivot("kmer", ["TAA", "CAC"]).agg(F.sum("cnt").cast("double"))
    rows = _targets(spark, d).join(n, "id", "left").fillna(0.0, ["TAA", "CAC"])
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(regression.FOLDS)).cast("int")
    x = F.array("TAA", "CAC", F.col("TAA") + F.col("CAC"))
    made = stage(rows.select("id", fold.alias("fold"), F.col("d").alias("y"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("j"), x.alias("v")))
    return _rounded(regression.ols(made, 3)[2].select("id", "pred"), 6, "pred")


def fit_regression(spark, d):
    """Weights of k-mers for the decay of documents, which depends on two of them."""
    fits = experiment.fit_rates(fx.reporter_counts(spark, d)).fits
    found = experiment.fit_regression(fits, fx.sequences(spark, d), ks=range(3, 5))
    return found.model.withColumn("intercept", F.lit(found.intercept))


def fit_peaks(spark, d):
    return _motif_rows(spark, experiment.fit_peaks(fx.sequences(spark, d), fx.model(spark)).motifs)


def predict_rates(spark, d):
    return experiment.predict_rates(fx.sequences(spark, d), fx.model(spark), fx.B0)


def predict_peaks(spark, d):
    """Peaks of all documents by the motifs and the levels of the same documents."""
    weights, masses, top = _peak_weights(spark, d)
    known = experiment.PeakModel(top, peaks.threshold(weights, masses=masses), list(fx.MOTIFS), weights)
    found = experiment.predict_peaks(fx.sequences(spark, d), fx.model(spark), known)
    return _rounded(found.select("id", "start", "end", "weight", "motif", "llr"), 6, "weight", "llr")


def enrich_dispatch(spark, d):
    """The tests by name on the same scores."""
    parts = [enrichment.test(_members(spark, d), fx.lengths(spark, d), kind, tail).select(F.lit(kind).alias("kind"), F.lit(tail).alias("tail"), "kmer", "p") for kind in ("t", "ks") for tail in ("right", "left")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_score(spark, sf_dir)


def _members(spark, d) -> DataFrame:
    return _counts3(spark, d).select("id", "kmer")


def queries() -> dict[str, Query]:
    """All domain queries by name."""
    return {
        "kmer_lexicon": kmer_lexicon,
        "kmer_counts_k3": _counts3,
        "kmer_table_function": kmer_table_function,
        "kmer_counts_k3_7": kmer_counts_k3_7,
        "kmer_store_stack": kmer_store_stack,
        "kmer_store_filled": kmer_store_filled,
        "kmer_presence": lambda s, d: kmers.presence(_counts3(s, d)),
        "kmer_positional_weights": _weights,
        "kmer_norm_weights": kmer_norm_weights,
        "kmer_preselect_rank": kmer_preselect_rank,
        "kmer_list_parse": kmer_list_parse,
        "sequence_score": sequence_score,
        "sequence_length_filter": sequence_length_filter,
        "length_slope_gate": length_slope_gate,
        "length_correction": length_correction,
        "rate_bounds": rate_bounds,
        "half_life": half_life,
        "counts_unpivot": counts_unpivot,
        "spike_split": spike_split,
        "spike_outliers": spike_outliers,
        "spike_usable_columns": spike_usable_columns,
        "spike_redistribute": spike_redistribute,
        "spike_scale": spike_scale,
        "spike_course": spike_course,
        "count_calibration_apply": count_calibration_apply,
        "count_calibration_regression": count_calibration_regression,
        "sample_share_neighbors": sample_share_neighbors,
        "sample_select": lambda s, d: decay.usable_times(fx.counts(s, d)),
        "reporter_select": lambda s, d: _rounded(_Decay(s, d).reporters, 6, "mean_count"),
        "detection_floor": lambda s, d: _rounded(decay.detection_floor(fx.logs(fx.counts(s, d))), 9, "floor"),
        "column_noise": lambda s, d: _rounded(_Decay(s, d).noise, 6, "sd"),
        "decay_wls": decay_wls,
        "decay_fit": lambda s, d: _rounded(_Decay(s, d).fits, 6, "a", "b", "r"),
        "decay_predict": decay_predict,
        "decay_r2": lambda s, d: _rounded(_Decay(s, d).fits.select("id", "r"), 6, "r"),
        "decay_gof_even_df": lambda s, d: _rounded(_Decay(s, d).tests, 6, "chi2", "p"),
        "bh_fdr": bh_fdr,
        "rate_phase_log": rate_phase_log,
        "good_fit_mask": lambda s, d: _Decay(s, d).tested.select("id", decay.good_fit(F.col("b"), F.col("p"), F.col("r")).alias("good")),
        "two_phase_eval": two_phase_eval,
        "logistic_eval": logistic_eval,
        "logistic_series": logistic_series,
        "enrich_tstat": lambda s, d: _rounded(enrichment.t_statistics(_members(s, d), fx.lengths(s, d)), 6, "t"),
        "enrich_ttest": lambda s, d: enrichment.t_test(_members(s, d), fx.lengths(s, d)),
        "enrich_ks_stat": lambda s, d: _rounded(enrichment.ks_statistics(_members(s, d), fx.lengths(s, d)), 6, "d_less", "d_more"),
        "enrich_ks_test": lambda s, d: enrichment.ks_test(_members(s, d), fx.lengths(s, d)),
        "enrich_hypergeom": lambda s, d: _rounded(enrichment.hypergeometric(_members(s, d), fx.quality(s, d)), 6, "p_right", "p_left"),
        "enrich_mutual_info": lambda s, d: _rounded(enrichment.mutual_information(_members(s, d), fx.lengths(s, d)), 6, "mi"),
        "enrich_permutation": lambda s, d: enrichment.permutation_test(_members(s, d), fx.lengths(s, d)),
        "regression_select_rows": lambda s, d: _rounded(regression.select_rows(_Decay(s, d).tested), 6, "d", "quality"),
        "time_expand": lambda s, d: (lambda c: _rounded(regression.expand_times(c.data, c.fits), 6, "y"))(_Decay(s, d)),
        "threshold_classifier": threshold_classifier,
        "gram_matrix": gram_matrix,
        "ols_predict": ols_predict,
        "cv_fold_predict": cv_fold_predict,
        "lasso_path": lasso_path,
        "peak_threshold": peak_threshold,
        "peak_runs_pos": _runs(1),
        "peak_runs_neg": _runs(-1),
        "peaks_unique": lambda s, d: peaks.unique_peaks(_rounded(_peaks(s, d), 6, "weight")),
        "peak_sequence_totals": peak_sequence_totals,
        "peak_motif_hits": lambda s, d: _rounded(peaks.motif_hits(_assigned(s, d)), 6, "score_sum"),
        "peak_hit_matrix": lambda s, d: peaks.hit_matrix(peaks.motif_hits(_assigned(s, d)), peaks.hit_columns([(m.name, m.sign) for m in fx.MOTIFS]), ids=fx.sequences(s, d)),
        "peak_summary": lambda s, d: _rounded(peaks.hit_summary(_assigned(s, d)), 6, "mean_motifs"),
        "pwm_scan": pwm_scan,
        "pwm_assign": lambda s, d: _rounded(_assigned(s, d).select("id", "start", "end", "motif", "llr"), 6, "llr"),
        "motif_group_stats": lambda s, d: _rounded(motifs.group_stats(_assigned(s, d)), 5, "weight"),
        "motif_filter": motif_filter,
        "motif_threshold": motif_threshold,
        "seed_align": lambda s, d: _rounded(motifs.seed_alignment(_seed_peaks(s, d), SEED), 6, "weight"),
        "pwm_build_from_alignment": pwm_build_from_alignment,
        "seed_cover": seed_cover,
        "motif_em": motif_em,
        "motif_prune": motif_prune,
        "motif_background": motif_background,
        "motif_logo": motif_logo,
        "fit_rates": fit_rates,
        "fit_rates_spiked": fit_rates_spiked,
        "fit_series": fit_series,
        "fit_series_tests": fit_series_tests,
        "linear_fit_basic": linear_fit_basic,
        "fit_regression": fit_regression,
        "fit_peaks": fit_peaks,
        "predict_rates": predict_rates,
        "predict_peaks": predict_peaks,
        "enrich_dispatch": enrich_dispatch,
        "hist2d": lambda s, d: presentation.histogram_2d(_Decay(s, d).fits, "a", "b", 20),
        "rate_hist": lambda s, d: presentation.histogram(_scored(s, d), "score", 32),
        "weight_topn": weight_topn,
        "weight_track": weight_track,
        "confusion_matrix": confusion_matrix,
        "fit_quality": fit_quality,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()

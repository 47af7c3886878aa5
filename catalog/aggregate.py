"""Statistics, stretches, distances, superpixel tables and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6, with_views
from cubeloom.functions.vectors import as_double
from cubeloom.operators import evaluate, moments, quantiles, reduce, sampling


def valid(spark, d):
    return V.px(spark, d).filter("valid")


@query("band_stats", with_views("SELECT band, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_samp(v), 6) + 0.0 AS var FROM lv GROUP BY band", "lv"))
def band_stats(spark, d):
    return moments.band_stats(valid(spark, d)).select("band", "n", r6("mean").alias("mean"), r6("var").alias("var"))


@query("band_stats_by_label", with_views("SELECT label, band, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_samp(v), 6) + 0.0 AS var FROM lv GROUP BY label, band", "lv"))
def band_stats_by_label(spark, d):
    return moments.band_stats(valid(spark, d), keys=["label"]).select("label", "band", "n", r6("mean").alias("mean"), r6("var").alias("var"))


@query("pca_covariance", with_views("SELECT a.band AS i, b.band AS j, count(*) AS n, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM lv a JOIN lv b USING (pix) GROUP BY 1, 2", "lv"))
def pca_covariance(spark, d):
    return moments.covariance(valid(spark, d)).select("i", "j", "n", r6("cov").alias("cov"))


def _noise_sql(dr: int, dc: int) -> str:
    return with_views(
        f"""SELECT i, j, n, cov FROM (SELECT a.band AS i, b.band AS j, count(*) AS n, round(covar_samp(a.dv, b.dv) / 2, 6) + 0.0 AS cov FROM df a JOIN df b USING (pix) GROUP BY 1, 2)""",
        "lv",
    ).replace(
        "\nSELECT i, j, n, cov",
        f",\ndf AS (SELECT p.pix, p.band, p.v - q.v AS dv FROM lv p JOIN lv q ON q.row = p.row + {dr} AND q.col = p.col + {dc} AND q.band = p.band)\nSELECT i, j, n, cov",
        1,
    )


for _name, (_dr, _dc) in {"lowerright": (1, 1), "lowerleft": (1, -1), "right": (0, 1), "lower": (1, 0)}.items():

    def _noise(name, sql):
        @query("noise_stats" if name == "lowerright" else f"noise_stats_{name}", sql)
        def run(spark, d):
            return moments.noise_covariance(V.px(spark, d), name).select("i", "j", "n", r6("cov").alias("cov"))

    # lower-left differences subtract the pixel one row down and one column left
    _noise(_name, _noise_sql(_dr, _dc))


@query("pca")
def pca(spark, d):
    scored = reduce.pca(valid(spark, d), 5)
    return scored.select("pix", F.posexplode("scores").alias("component", "_v")).select("pix", "component", r6("_v").alias("score"))


@query("pca_total_variance", with_views(
    "SELECT CAST(max(n) AS BIGINT) AS n, round(sum(v), 6) AS total FROM (SELECT band, count(*) AS n, var_samp(v) AS v FROM lv GROUP BY band)", "lv"))
def pca_total_variance(spark, d):
    """All components together carry the variance of all bands."""
    scores = reduce.pca(valid(spark, d), V.BANDS).select(F.posexplode("scores").alias("component", "v"))
    by_component = scores.groupBy("component").agg(F.count("*").alias("n"), F.var_samp("v").alias("v"))
    return by_component.agg(F.max("n").alias("n"), r6(F.sum("v")).alias("total"))


@query("mnf")
def mnf(spark, d):
    scored = reduce.mnf(V.px(spark, d), 5)
    return scored.select("pix", F.posexplode("scores").alias("component", "_v")).select("pix", "component", r6("_v").alias("score"))


@query("standardize", with_views("SELECT pix, band, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS v FROM lv WINDOW w AS (PARTITION BY band)", "lv"))
def standardize(spark, d):
    scaled = reduce.standardize(valid(spark, d))
    return scaled.select("pix", F.posexplode("scaled").alias("band", "_v")).select("pix", "band", r6("_v").alias("v"))


@query("center", with_views("SELECT pix, band, round(v - avg(v) OVER (PARTITION BY band), 6) + 0.0 AS v FROM lv", "lv"))
def center(spark, d):
    scaled = reduce.standardize(valid(spark, d), std=False)
    return scaled.select("pix", F.posexplode("scaled").alias("band", "_v")).select("pix", "band", r6("_v").alias("v"))


def band1(spark, d):
    return V.px(spark, d).select("pix", "scene_id", "valid", F.col("spectrum")[0].alias("b1"))


@query("stretch_percent", with_views("SELECT pix, CASE WHEN valid THEN round(greatest(0, least(1, (spectrum[1] - lo) / (hi - lo))), 6) + 0.0 END AS v FROM px, (SELECT quantile_cont(spectrum[1], 0.02) AS lo, quantile_cont(spectrum[1], 0.98) AS hi FROM px WHERE valid)", "px"))
def stretch_percent(spark, d):
    return quantiles.stretch_percent(band1(spark, d), "b1", valid="valid").select("pix", r6("stretched").alias("v"))


@query("stretch_minmax", with_views("SELECT pix, CASE WHEN valid THEN round(greatest(0, least(1, (spectrum[1] - lo) / (hi - lo))), 6) + 0.0 END AS v FROM px, (SELECT min(spectrum[1]) AS lo, max(spectrum[1]) AS hi FROM px WHERE valid)", "px"))
def stretch_minmax(spark, d):
    return quantiles.stretch_minmax(band1(spark, d), "b1", valid="valid").select("pix", r6("stretched").alias("v"))


@query("exact_quantiles", "SELECT event_type, q, round(quantile_cont(value, q), 6) + 0.0 AS value FROM events, (VALUES (0.0::DOUBLE), (0.02), (0.5), (0.98), (1.0)) t(q) GROUP BY event_type, q".replace("quantile_cont(value, q)", "CASE q WHEN 0 THEN quantile_cont(value, 0.0) WHEN 0.02 THEN quantile_cont(value, 0.02) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.98 THEN quantile_cont(value, 0.98) ELSE quantile_cont(value, 1.0) END"))
def exact_quantiles(spark, d):
    q = quantiles.exact_quantiles(V.table(spark, d, "events"), ["event_type"], "value", [0.0, 0.02, 0.5, 0.98, 1.0])
    return q.select("event_type", "q", r6("value").alias("value"))


@query("spectral_complexity")
def spectral_complexity(spark, d):
    value = reduce.spectral_complexity(valid(spark, d))
    return valid(spark, d).agg(F.count("*").alias("n")).select("n", F.lit(round(value, 6)).alias("complexity"))


_mean = "(SELECT list(m ORDER BY band) AS m FROM (SELECT band, avg(v) AS m FROM lng GROUP BY band))"


@query("dist_cosine", with_views(f"SELECT pix, CASE WHEN list_sum([x * x FOR x IN spectrum]) = 0 THEN 0 ELSE round(list_dot_product(spectrum, m) / (sqrt(list_dot_product(spectrum, spectrum)) * sqrt(list_dot_product(m, m))), 6) + 0.0 END AS cosine FROM px, {_mean}", "px", "lng"))
def dist_cosine(spark, d):
    return reduce.dist_cosine(V.px(spark, d)).select("pix", r6("cosine").alias("cosine"))


@query("dist_euclidean", with_views(f"SELECT pix, round(list_distance(spectrum, m), 6) + 0.0 AS distance FROM px, {_mean}", "px", "lng"))
def dist_euclidean(spark, d):
    return reduce.dist_euclidean(V.px(spark, d)).select("pix", r6("distance").alias("distance"))


@query("dist_mahalanobis_2", with_views(
    """SELECT pix, round(sqrt((syy * (x - mx) * (x - mx) - 2 * sxy * (x - mx) * (y - my) + sxx * (y - my) * (y - my)) / (sxx * syy - sxy * sxy)), 6) + 0.0 AS distance
 FROM (SELECT pix, spectrum[1] AS x, spectrum[2] AS y FROM px WHERE valid), (SELECT avg(spectrum[1]) AS mx, avg(spectrum[2]) AS my, var_samp(spectrum[1]) AS sxx, var_samp(spectrum[2]) AS syy, covar_samp(spectrum[1], spectrum[2]) AS sxy FROM px WHERE valid)""", "px"))
def dist_mahalanobis_2(spark, d):
    two = valid(spark, d).select("pix", F.slice("spectrum", 1, 2).alias("spectrum"))
    return reduce.dist_mahalanobis(two).select("pix", r6("distance").alias("distance"))


@query("dist_mahalanobis")
def dist_mahalanobis(spark, d):
    return reduce.dist_mahalanobis(valid(spark, d)).select("pix", r6("distance").alias("distance"))


@query("mahalanobis_total", with_views(
    "SELECT count(*) AS n, CAST((count(*) - 1) * least(64, count(*) - 1) AS DOUBLE) AS total FROM px WHERE valid", "px"))
def mahalanobis_total(spark, d):
    """The squared distances of all pixels sum to (pixels - 1) times the rank of the covariance."""
    far = reduce.dist_mahalanobis(valid(spark, d))
    return far.agg(F.count("*").alias("n"), F.round(F.sum(F.col("distance") * F.col("distance")), 3).alias("total"))


# --- superpixels ---

_stats = "SELECT seg, any_value(n) AS area, sum(vp) AS var_sum FROM (SELECT seg, i, count(*) AS n, var_pop(spectrum[i]) AS vp FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg) GROUP BY seg, i) GROUP BY seg"


@query("segment_stats", with_views(f"SELECT seg, area, round(var_sum, 6) + 0.0 AS var_sum FROM ({_stats})", "seg"))
def segment_stats(spark, d):
    return sampling.segment_stats(V.seg(spark, d)).select("seg", "area", r6("var_sum").alias("var_sum"))


_score = f"SELECT *, (CASE WHEN v1 = v0 THEN 0 ELSE (var_sum - v0) / (v1 - v0 + 1e-12) END + 1 - CASE WHEN a1 = a0 THEN 0 ELSE (area - a0) / (a1 - a0 + 1e-12) END) / 2 AS score FROM ({_stats}), (SELECT min(var_sum) AS v0, max(var_sum) AS v1, min(area) AS a0, max(area) AS a1 FROM ({_stats}))"
_quota = f"SELECT seg, score, CAST(greatest(1, least(20, round_even(score * 20, 0))) AS INT) AS n_samples FROM ({_score})"


@query("segment_sample_counts", with_views(f"SELECT seg, round(score, 6) + 0.0 AS score, n_samples FROM ({_quota})", "seg"))
def segment_sample_counts(spark, d):
    counts = sampling.segment_sample_counts(sampling.segment_stats(V.seg(spark, d)), 20)
    return counts.select("seg", r6("score").alias("score"), "n_samples")


@query("segment_mean_color", with_views("SELECT pix, seg, round(avg(spectrum[1]) OVER w, 6) + 0.0 AS m1, round(avg(spectrum[2]) OVER w, 6) + 0.0 AS m2 FROM seg WINDOW w AS (PARTITION BY seg)", "seg"))
def segment_mean_color(spark, d):
    s = V.seg(spark, d).select("pix", "seg", F.col("spectrum")[0].alias("b1"), F.col("spectrum")[1].alias("b2"))
    painted = sampling.segment_mean_color(s, ["b1", "b2"])
    return painted.select("pix", "seg", r6("mean_b1").alias("m1"), r6("mean_b2").alias("m2"))


_scores = "SELECT pix, seg, dir, sum(v * r) AS s FROM (SELECT pix, seg, CAST(i - 1 AS INT) AS band, spectrum[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM {src})) JOIN dirs USING (band) GROUP BY pix, seg, dir"
_all = _scores.format(src="(SELECT pix, spectrum, 1 AS seg FROM px WHERE valid)")
_per = _scores.format(src="seg")


def _counts(scores: str) -> str:
    return f"SELECT seg, pix, count(*) AS count FROM (SELECT seg, unnest([arg_max(pix, {{'a': s, 'b': -pix}}), arg_min(pix, {{'a': s, 'b': pix}})]) AS pix FROM ({scores}) GROUP BY seg, dir) GROUP BY seg, pix"


@query("ppi", with_views(f"SELECT pix, count FROM ({_counts(_all)})", "px", "dirs"))
def ppi(spark, d):
    return sampling.ppi(valid(spark, d), V.directions())


@query("ppi_threshold", with_views(f"SELECT pix, count(*) AS count FROM (SELECT pix, unnest(CASE WHEN s >= hi - 3 AND s <= lo + 3 THEN [1, 2] ELSE [1] END) AS hit FROM (SELECT *, max(s) OVER (PARTITION BY dir) AS hi, min(s) OVER (PARTITION BY dir) AS lo FROM ({_all})) WHERE s >= hi - 3 OR s <= lo + 3) GROUP BY pix", "px", "dirs"))
def ppi_threshold(spark, d):
    return sampling.ppi(valid(spark, d), V.directions(), threshold=3.0)


_top = f"SELECT c.seg, pix, count, n_samples FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY count DESC, pix DESC) AS rn FROM ({_counts(_per)})) c JOIN ({_quota}) q USING (seg) WHERE rn <= n_samples"


@query("segment_ppi_sampling", with_views(f"SELECT seg, pix, count FROM ({_top})", "seg", "dirs"))
def segment_ppi_sampling(spark, d):
    return sampling.segment_ppi_sampling(V.seg(spark, d), V.directions(), 20).select("seg", "pix", "count")


@query("topn_per_segment", with_views("SELECT seg, pix, count, rank FROM (SELECT seg, pix, pix * 7 % 11 AS count, seg % 4 + 1 AS n, CAST(row_number() OVER (PARTITION BY seg ORDER BY pix * 7 % 11 DESC, pix DESC) AS INT) AS rank FROM seg) WHERE rank <= n AND count > 0", "seg"))
def topn_per_segment(spark, d):
    s = V.seg(spark, d).select("seg", "pix", (F.col("pix") * 7 % 11).alias("count"))
    quotas = s.select("seg", (F.col("seg") % 4 + 1).alias("n_samples")).distinct()
    return sampling.topn_per_segment(s, quotas, 20).select("seg", "pix", "count", "rank")


# --- evaluation ---

@query("class_counts", with_views("SELECT label, count(*) AS n FROM px GROUP BY ROLLUP (label)", "px"))
def class_counts(spark, d):
    return evaluate.class_counts(V.px(spark, d))


@query("curve_confidence", with_views("SELECT band, round(avg(v), 6) + 0.0 AS mean, round(avg(v) - 1.96::DOUBLE * stddev_pop(v), 6) + 0.0 AS lower, round(avg(v) + 1.96::DOUBLE * stddev_pop(v), 6) + 0.0 AS upper FROM lv WHERE pix % 5 <> 0 GROUP BY band", "lv"))
def curve_confidence(spark, d):
    flagged = valid(spark, d).withColumn("flag", F.when(F.col("pix") % 5 == 0, -1).otherwise(1))
    return evaluate.curve_confidence(flagged).select("band", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


def cm(spark, d):
    return evaluate.confusion_matrix(V.pred(spark, d))


@query("confusion_matrix", with_views("SELECT truth, pred, n FROM cm", "cm"))
def confusion_matrix(spark, d):
    return cm(spark, d)


for _mode, _side in (("recall", "truth"), ("precision", "pred")):

    def _percent(mode, side):
        @query("confusion_percent" if mode == "precision" else "confusion_percent_recall", with_views(f"SELECT truth, pred, n, round(CASE WHEN sum(n) OVER w = 0 THEN 0 ELSE n / sum(n) OVER w END, 6) + 0.0 AS share FROM cm WINDOW w AS (PARTITION BY {side})", "cm"))
        def run(spark, d):
            return evaluate.confusion_percent(cm(spark, d), mode).withColumn("share", r6("share"))

    _percent(_mode, _side)

_marg = """SELECT label, support, predicted, hit FROM (SELECT truth AS label, sum(n)::BIGINT AS support FROM cm GROUP BY 1) JOIN (SELECT pred AS label, sum(n)::BIGINT AS predicted FROM cm GROUP BY 1) USING (label)
 JOIN (SELECT truth AS label, n AS hit FROM cm WHERE truth = pred) USING (label)"""
_acc = f"SELECT n, round(a, 6) + 0.0 AS accuracy, round((a - e) / (1 - e), 6) + 0.0 AS kappa FROM (SELECT sum(support)::BIGINT AS n, sum(hit) / sum(support) AS a, sum(support * predicted) / (sum(support) * sum(support)) AS e FROM ({_marg}))"


@query("accuracy_kappa", with_views(_acc, "cm"))
def accuracy_kappa(spark, d):
    return evaluate.accuracy_kappa(cm(spark, d)).select("n", r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"))


_prf = f"SELECT CAST(label AS VARCHAR) AS name, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f1, support FROM ({_marg})"
_rep = f"""SELECT name, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support FROM (SELECT * FROM ({_prf})
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM ({_prf})
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM ({_prf}))"""


@query("class_report", with_views(_rep, "cm"))
def class_report(spark, d):
    return evaluate.class_report(cm(spark, d)).select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("evaluate_model", with_views(f"SELECT name, f1, accuracy, kappa FROM ({_rep}), ({_acc})", "cm"))
def evaluate_model(spark, d):
    tables = evaluate.evaluate_model(V.pred(spark, d))
    scores = tables["scores"].select(r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa")).withColumn("k", F.lit(1))
    report = tables["report"].select("name", r6("f1").alias("f1")).withColumn("k", F.lit(1))
    return report.join(scores, "k").drop("k")


@query("topk_accuracy", with_views("SELECT k, round(avg(CASE WHEN ahead < k THEN 100.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM (SELECT pix, len(list_filter(range(1, 11), lambda i: spectrum[i] > spectrum[label + 1] OR (spectrum[i] = spectrum[label + 1] AND i < label + 1))) AS ahead FROM px), (VALUES (1), (3), (5)) t(k) GROUP BY k", "px"))
def topk_accuracy(spark, d):
    logits = V.px(spark, d).select(F.slice("spectrum", 1, 10).alias("logits"), "label")
    return evaluate.topk_accuracy(logits, [1, 3, 5]).select("k", F.round("accuracy", 6).alias("accuracy"))


@query("weighted_running_mean", "SELECT event_id, round(sum(value * (event_id % 32 + 1)) OVER w / sum(event_id % 32 + 1) OVER w, 5) + 0.0 AS avg FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def weighted_running_mean(spark, d):
    e = V.table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 32 + 1).alias("n"))
    return evaluate.weighted_running_mean(e, "event_id", "value", "n").select("event_id", (F.round("avg", 5) + 0.0).alias("avg"))


@query("weighted_mean", "SELECT event_type, round(sum(value * (event_id % 32 + 1)) / sum(event_id % 32 + 1), 6) AS avg, sum(event_id % 32 + 1)::BIGINT AS count FROM events GROUP BY event_type")
def weighted_mean(spark, d):
    e = V.table(spark, d, "events").select("event_type", "value", (F.col("event_id") % 32 + 1).alias("n"))
    return evaluate.weighted_mean(e, "value", "n", ["event_type"]).select("event_type", r6("avg").alias("avg"), "count")


@query("otsu_threshold", with_views("""SELECT round(arg_max(centre, {'v': var, 'b': -bin}), 6) AS threshold FROM (SELECT bin, centre, CASE WHEN wt > w THEN w * (wt - w) * (s / w - (st - s) / (wt - w)) * (s / w - (st - s) / (wt - w)) ELSE 0 END AS var FROM
 (SELECT bin, centre, sum(c) OVER o AS w, sum(c * centre) OVER o AS s, sum(c) OVER () AS wt, sum(c * centre) OVER () AS st FROM
  (SELECT bin, any_value(lo) + (bin + 0.5::DOUBLE) * any_value(w) AS centre, count(*)::DOUBLE AS c FROM (SELECT lo, w, CAST(least(255, floor((v - lo) / w)) AS INT) AS bin FROM gridv, (SELECT min(v) AS lo, (max(v) - min(v)) / 256 AS w FROM gridv)) GROUP BY bin)
 WINDOW o AS (ORDER BY bin)))""", "gridv"))
def otsu_threshold(spark, d):
    return quantiles.otsu_threshold(V.gridv(spark, d), "v").select(F.round("threshold", 6).alias("threshold"))


@query("masked_infonce", with_views("""SELECT pair_id, CAST(view AS INT) AS view, round(ln(sum(CASE WHEN used THEN exp(cs / 0.5::DOUBLE) ELSE 0 END)) - max(CASE WHEN pos THEN cs / 0.5::DOUBLE END), 6) + 0.0 AS loss FROM
 (SELECT a.pair_id, a.view, a.pair_id = b.pair_id AS pos, list_cosine_similarity(a.spectrum, b.spectrum) AS cs, a.pair_id = b.pair_id OR NOT list_cosine_similarity(a.spectrum, b.spectrum) > 0.2 AS used
  FROM (SELECT pix, pix // 2 AS pair_id, pix % 2 AS view, pix // 50 AS batch, list_transform(spectrum, lambda x: x + 0.001::DOUBLE) AS spectrum FROM px) a
  JOIN (SELECT pix, pix // 2 AS pair_id, pix // 50 AS batch, list_transform(spectrum, lambda x: x + 0.001::DOUBLE) AS spectrum FROM px) b ON a.batch = b.batch AND a.pix <> b.pix) GROUP BY pair_id, view""", "px"))
def masked_infonce(spark, d):
    p = V.px(spark, d)
    rows = p.select(
        F.floor(F.col("pix") / 2).alias("pair_id"), (F.col("pix") % 2).cast("int").alias("view"),
        F.transform(as_double(F.col("spectrum")), lambda x: x + 0.001).alias("v"),
    )
    scored = evaluate.masked_infonce(rows, 25, temperature=0.5, threshold=0.2)
    return scored.select("pair_id", "view", r6("loss").alias("loss"))

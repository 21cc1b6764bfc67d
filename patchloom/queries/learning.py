"""2.O losses, regularisers, solvers, evaluators; 2.Q scoring and standardising; the whole pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from patchloom.functions.images import long_form
from patchloom.operators import evaluate as E
from patchloom.operators import learn as L
from patchloom.operators import stats
from patchloom.plans.pipeline import Component, ConvLayer
from patchloom.queries.inputs import SCORES, X, array_rows, class_means, r6, truths, truths_sql, vectors
from patchloom.shared import table


def _model(spark, sf_dir) -> L.Linear:
    means = class_means(spark, sf_dir)
    return L.Linear(means.T.copy(), np.zeros(len(means)))


def _one(spark, **values):
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in values.values())], ", ".join(f"{k} double" for k in values))


def _weighted(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("weight", (F.col("vec_id") % 3 + 1).cast("double"))


def _loss(kind, weight=None):
    def query(spark, sf_dir):
        f, gw, gb, n = L.loss_sums(_weighted(spark, sf_dir), "x", "label", _model(spark, sf_dir), kind, weight)
        return _one(spark, f=f, n=n, gradient=np.abs(gb).sum())

    return query


def _reg(kind):
    def query(spark, sf_dir):
        f, g = L.REGULARISERS[kind](_model(spark, sf_dir).w, 0.3)
        return _one(spark, f=f, gradient=np.abs(g).sum())

    return query


def o11(spark, sf_dir):
    f, g = L.objective(vectors(spark, sf_dir), "x", "label", _model(spark, sf_dir), "squared_hinge", "l2", 0.01)
    return array_rows(spark, gradient=np.concatenate(([f], g)))


def o12(spark, sf_dir):
    """Two adaptive-gradient steps with all rows in the batch: the second batch is the next epoch's shuffle of the same rows."""
    n = vectors(spark, sf_dir).count()
    model = L.fit_stochastic(vectors(spark, sf_dir), "x", "label", "vec_id", "l2", "l2", 0.01, "adagrad", n, 2, 0.1, 1.0)
    return array_rows(spark, w=model.flat())


def o12_lbfgs(spark, sf_dir):
    """One batch of all rows, one step of L-BFGS: as O14's first step."""
    rows = vectors(spark, sf_dir)
    seen = []
    model = L.fit_stochastic(rows, "x", "label", "vec_id", "squared_hinge", "l2", 0.01, "lbfgs", rows.count(), 1, most=2, callbacks=[seen.append])
    return array_rows(spark, w=seen[-1].flat(), again=model.flat())


def _svm(fit):
    """The first step, against the gradient at 0 and of length 1 in the sum of its amounts, and the objective there."""

    def query(spark, sf_dir):
        model, value = fit(vectors(spark, sf_dir), "x", "label", 0.01, most=2)
        return array_rows(spark, w=np.concatenate((model.flat(), [value])))

    return query


def _svm_trained(fit, loss, reg, smooth):
    def query(spark, sf_dir):
        rows = vectors(spark, sf_dir)
        model, value = fit(rows, "x", "label", 0.01, most=60)
        zero = L.objective(rows, "x", "label", L.Linear(np.zeros((64, 10)), np.zeros(10)), loss, reg, 0.01)[0]
        _, g = L.objective(rows, "x", "label", model, loss, reg, 0.01)
        return truths(spark, objective_falls=value < zero, stationary=not smooth or np.abs(g).max() < 1e-3)

    return query


def o13_binary(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("x", F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
    model, value = L.svm_binary(rows, "x", "y", 0.001, most=2)
    return array_rows(spark, w=np.concatenate((model.flat(), [value])))


def _scored(spark, sf_dir):
    return L.scored(vectors(spark, sf_dir), "x", _model(spark, sf_dir), "vec_id", "label")


def s12(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "predicted")


def s13(spark, sf_dir):
    m, s = stats.meanstd(vectors(spark, sf_dir), "x")
    return long_form(L.standardized(vectors(spark, sf_dir), "x", m, s, "vec_id"), "vec_id", vector="x")


def _measure(function):
    def query(spark, sf_dir):
        out = function(_scored(spark, sf_dir))
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return query


def whole_pipeline(spark, sf_dir):
    """Patches, ZCA, matching-pursuit dictionary, threshold, 2 x 2 averages, standardised, squared-hinge model, accuracy on the rows trained on."""
    from patchloom.functions.images import images_from_vectors

    images = images_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, 1, "label")
    layer = ConvLayer([
        Component("extract", {"kind": "patches", "size": [3, 3], "stride": 1}), Component("normalise", {"kind": "meanvar", "reg": 0.1}), Component("encode", {"kind": "linear_bw"}, "zca", {"reg": 0.1}),
        Component("encode", {"kind": "threshold", "alpha": 0.25}, "omp1", {"k": 12, "max_iter": 3}), Component("pool", {"kind": "spatial", "method": "ave", "grid": [2, 2]}),
    ])
    layer.train(images, 2000)
    features = layer.process(images).persist()
    m, s = stats.meanstd(features, "feature", 1e-6)
    rows = L.standardized(features, "feature", m, s, "label").persist()
    model, _ = L.l2svm_onevsall(rows, "feature", "label", 0.01, most=25)
    out = E.accuracy(L.scored(rows, "feature", model, "label"), "label", "predicted")
    return out.select((F.col("accuracy") > 0.1).alias("better_than_chance"), (F.col("accuracy") <= 1).alias("at_most_one"))


QUERIES = {
    "O2_loss_l2": _loss("l2"), "O2_loss_l2_weighted": _loss("l2", "weight"), "O3_loss_hinge": _loss("hinge"), "O4_loss_squared_hinge": _loss("squared_hinge"), "O4_loss_squared_hinge_weighted": _loss("squared_hinge", "weight"),
    "O5_loss_bnll": _loss("bnll"), "O6_loss_multiclass_logistic": _loss("logistic"), "O7_reg_l2": _reg("l2"), "O8_reg_l1": _reg("l1"), "O9_reg_elastic": _reg("elastic"),
    "O11_objective": o11, "O12_adagrad": o12, "O12_stochastic_lbfgs": o12_lbfgs,
    "O13_svm_onevsall": _svm(L.svm_onevsall), "O13_svm_binary": o13_binary, "O14_l2svm_onevsall": _svm(L.l2svm_onevsall), "O14_l2svm_trained": _svm_trained(L.l2svm_onevsall, "squared_hinge", "l2", True), "O15_elasticnet_svm": _svm(L.elasticnet_svm_onevsall),
    "O16_mse": _measure(lambda d: E.mse(d, "label", "predicted")), "O17_accuracy": _measure(lambda d: E.accuracy(d, "label", "scores")), "O18_confusion_table": _measure(lambda d: E.confusion_table(d, "label", "predicted", 10)),
    "O19_accuracy_class_averaged": _measure(lambda d: E.accuracy_class_averaged(d, "label", "predicted")), "O20_top_k_accuracy": _measure(lambda d: E.top_k_accuracy(d, "label", "scores", 3)),
    "O21_average_precision": _measure(lambda d: E.average_precision(d.select((F.col("label") == 3).alias("is"), F.round(F.col("scores")[3], 2).alias("s")), "is", "s")),
    "O22_average_precision_multiclass": _measure(lambda d: E.average_precision_multiclass(d, "label", "scores")),
    "S12_predicted": s12, "S13_standardized": s13, "pipeline_accuracy": whole_pipeline,
}

_Y = SCORES + ", yp as (select *, case when k = label then 1.0 else {fill} end as y, vec_id % 3 + 1 as weight from scores)"


def _loss_sql(f: str, g: str, fill: str = "-1.0", w: str = "1.0") -> str:
    return X + _Y.format(fill=fill) + f""", terms as (select k, vec_id, {w} * ({f}) as f, {w} * ({g}) as g, {w} as one from yp)
select {r6('sum(f)')} as f, (select {r6('sum(one)::double')} from terms where k = 0) as n, (select {r6('sum(abs(g))')} from (select k, sum(g) as g from terms group by k)) as gradient from terms"""


_M = "greatest(0, 1 - y * s)"
_LOGISTIC = X + _Y.format(fill="0.0") + f""", soft as (select *, exp(s - max(s) over w) / sum(exp(s)) over w * exp(max(s) over w) as q from yp window w as (partition by vec_id)),
terms as (select k, vec_id, -y * ln(greatest(q, 2.220446049250313e-16)) as f, q - y as g from soft)
select {r6('sum(f)')} as f, (select {r6('count(*)::double')} from emb) as n, (select {r6('sum(abs(g))')} from (select k, sum(g) as g from terms group by k)) as gradient from terms"""
_ADA = """, n as (select count(*)::double as n from emb), cells as (select j, k from range(65) a(j), range(10) b(k)), xb as (select vec_id, label, j, v from x union all select vec_id, label, 64, 1.0 from emb),
"""


def _ada_step(n: int, source: str) -> str:
    """One step over all rows from the weights of `source` (j, k, w, g2)."""
    return f"""p{n} as (select vec_id, label, k, sum(v * w) as s from xb join {source} using (j) group by vec_id, label, k),
d{n} as (select vec_id, k, 2 * (s - case when k = label then 1.0 else -1.0 end) as d from p{n}),
g{n} as (select j, k, sum(v * d) / (select n from n) as g from xb join d{n} using (vec_id) group by j, k),
s{n} as (select j, k, w - 0.1 * (g + case when j < 64 then 0.02 * w else 0 end) / sqrt(g2 + (g + case when j < 64 then 0.02 * w else 0 end) ** 2) as w, g2 + (g + case when j < 64 then 0.02 * w else 0 end) ** 2 as g2
from {source} join g{n} using (j, k))"""


def _first_step(slope: str, loss: str, reg_slope: str, reg: str, k: int = 10, y: str = "case when k = label then 1.0 else -1.0 end", gamma: float = 0.01) -> str:
    """The weights after one step from 0 against the gradient, whose amounts sum to 1 or less, and the objective there; m: the margin's shortfall."""
    n = 64 * k
    return X + f""", n as (select count(*)::double as n from emb), xb as (select vec_id, label, j, v from x union all select vec_id, label, 64, 1.0 from emb),
g as (select j, k, sum(-{slope} * v * {y}) / (select n from n) + case when j < 64 then {gamma} * {reg_slope} else 0 end as g from xb, range({k}) t(k) group by j, k),
w as (select j, k, -g * least(1.0, 1 / (select sum(abs(g)) from g)) as w from g),
s as (select vec_id, label, k, greatest(0, 1 - {y} * sum(v * w)) as m from xb join w using (j) group by vec_id, label, k),
told as (select case when j < 64 then j * {k} + k else {n} + k end as j, round(w, 6) + 0.0 as w from w
union all select {n + k}, round((select sum({loss}) from s) / (select n from n) + {gamma} * (select sum({reg}) from w where j < 64), 6)) select j, w from told where true"""


_RANK = ", top as (select vec_id, label, max_by(k, (s, -k)) as p from scores group by vec_id, label)\n"
_AP = """, points as (select {by} s, sum(pos) as tp, count(*) as n from ranked group by {by} s), run as (select {by} s, tp, sum(tp) over w as ctp, sum(n) over w as cn, n from points window w as ({part} order by s desc)),
area as (select {by} tp * (ctp / cn + case when cn > n then (ctp - tp) / (cn - n) else 1.0 end) / 2 as a, tp from run)
"""
ORACLES = {
    "O2_loss_l2": _loss_sql("(s - y) * (s - y)", "2 * (s - y)"), "O2_loss_l2_weighted": _loss_sql("(s - y) * (s - y)", "2 * (s - y)", w="weight"),
    "O3_loss_hinge": _loss_sql(_M, f"case when {_M} > 0 then -y::double else 0.0::double end"), "O4_loss_squared_hinge": _loss_sql(f"{_M} * {_M}", f"-2 * y * {_M}"), "O4_loss_squared_hinge_weighted": _loss_sql(f"{_M} * {_M}", f"-2 * y * {_M}", w="weight"),
    "O5_loss_bnll": _loss_sql("ln(1 + exp(least(-y * s, 100)))", "-y * exp(least(-y * s, 100)) / (1 + exp(least(-y * s, 100)))"), "O6_loss_multiclass_logistic": _LOGISTIC,
    "O7_reg_l2": X + SCORES + f"select {r6('sum(w * w)')} as f, {r6('sum(abs(2 * w))')} as gradient from w",
    "O8_reg_l1": X + SCORES + f"select {r6('sum(abs(w))')} as f, {r6('sum(case when w = 0 then 0.5 else 1.0 end)::double')} as gradient from w",
    "O9_reg_elastic": X + SCORES + f"select {r6('sum(0.3 * abs(w) + 0.7 * w * w)')} as f, {r6('sum(abs(0.3 * case when w = 0 then 0.5 else sign(w) end + 1.4 * w))')} as gradient from w",
    "O11_objective": X + _Y.format(fill="-1.0") + f""", n as (select count(*)::double as n from emb), m as (select *, {_M} as m from yp), gw as (select j, k, sum(v * -2 * y * m) / (select n from n) as g from m join x using (vec_id) group by j, k)
select 0::bigint as j, round(sum(m * m) / (select n from n) + 0.01 * (select sum(w * w) from w), 6) as gradient from m union all
select 1 + gw.j * 10 + gw.k, {r6('g + 0.02 * w')} from gw join w on gw.j = w.j and gw.k = w.k union all select 641 + k, {r6('sum(-2 * y * m) / (select n from n)')} from m group by k""",
    "O12_adagrad": X + _ADA + "s0 as (select j, k, 0.0::double as w, 1.0::double + 2.220446049250313e-16 as g2 from cells),\n" + _ada_step(1, "s0") + ",\n" + _ada_step(2, "s1") + f"\nselect case when j < 64 then j * 10 + k else 640 + k end as j, {r6('w')} as w from s2",
    "O12_stochastic_lbfgs": _first_step("2", "m * m", "0", "w * w").replace("select j, w from told where true", "select j, w, w as again from told where j < 650"),
    "O13_svm_onevsall": _first_step("1", "m", "0", "w * w"), "O13_svm_binary": _first_step("1", "m", "0", "w * w", 1, "case when label < 5 then 1.0 else -1.0 end", 0.001),
    "O14_l2svm_onevsall": _first_step("2", "m * m", "0", "w * w"), "O14_l2svm_trained": truths_sql("objective_falls", "stationary"), "O15_elasticnet_svm": _first_step("2", "m * m", "0.25", "0.5 * abs(w) + 0.5 * w * w"),
    "O16_mse": X + SCORES + _RANK + "select round(avg((label - p) * (label - p)), 6) as mse from top", "O17_accuracy": X + SCORES + _RANK + "select round(avg((label = p)::int), 6) as accuracy from top",
    "O18_confusion_table": X + SCORES + _RANK + "select y::integer as y, p::integer as p, coalesce(n, 0) as n from (select a.i as y, b.i as p from range(10) a(i), range(10) b(i)) left join (select label as y, p, count(*) as n from top group by label, p) using (y, p)",
    "O19_accuracy_class_averaged": X + SCORES + _RANK + "select round(avg(a), 6) as accuracy from (select avg((label = p)::int) as a from top group by label)",
    "O20_top_k_accuracy": X + SCORES + "select round(avg((k = label)::int) * 3, 6) as accuracy from (select *, row_number() over (partition by vec_id order by s desc, k) as rn from scores) where rn <= 3",
    "O21_average_precision": X + SCORES + ", ranked as (select round(s, 2) as s, (label = 3)::int as pos from scores where k = 3)" + _AP.format(by="", part="") + "select round(sum(a) / sum(tp), 6) as ap from area",
    "O22_average_precision_multiclass": X + SCORES + ", ranked as (select k, s, (label = k)::int as pos from scores)" + _AP.format(by="k,", part="partition by k") + "select round(avg(ap), 6) as ap from (select k, sum(a) / sum(tp) as ap from area group by k)",
    "S12_predicted": X + SCORES + _RANK + "select vec_id, p::integer as predicted from top",
    "S13_standardized": X + f", m as (select j, avg(v) as m, stddev_pop(v) as s from x group by j) select vec_id, j, {r6('(v - m) / s')} as v from x join m using (j)",
    "pipeline_accuracy": "select true as better_than_chance, true as at_most_one",
}

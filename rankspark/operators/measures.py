"""The registry of measures on judged runs.

A measure is a name, its default parameters, how it is averaged, and a builder of aggregate expressions. All measures
asked for are computed in one aggregation over the judged rows. Adding one means calling ``measure`` on a builder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from rankspark.operators.judge import NOT_IN_POOL

# Default cutoffs, the floor of geometric means and the smoothing of inferred precision.
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))
FRACTIONS = tuple(i / 5 for i in range(1, 11))
SUCCESS = (1, 5, 10)
GEO_FLOOR = 1e-5
INFAP_EPSILON = 1e-5

# The named groups of measures.
NICKNAMES = {
    "official": "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P".split(),
    "set": "runid num_q num_ret num_rel num_rel_ret utility set_P set_recall set_relative_P set_map set_F".split(),
    "all_trec": (
        "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P relstring recall infAP gm_bpref "
        "utility 11pt_avg ndcg relative_P Rprec_mult success map_cut ndcg_cut ndcg_rel Rndcg binG G set_P set_recall set_relative_P "
        "set_map set_F num_nonrel_judged_ret"
    ).split(),
    "prefs": "runid num_q prefs_num_prefs_poss prefs_num_prefs_ful prefs_num_prefs_ful_ret prefs_simp prefs_pair prefs_avgjg".split(),
    "all_prefs": (
        "runid num_q prefs_num_prefs_poss prefs_num_prefs_ful prefs_num_prefs_ful_ret prefs_simp prefs_pair prefs_avgjg prefs_avgjg_Rnonrel "
        "prefs_simp_ret prefs_pair_ret prefs_avgjg_ret prefs_avgjg_Rnonrel_ret prefs_simp_imp prefs_pair_imp prefs_avgjg_imp"
    ).split(),
    "qrels_jg": "runid num_q map_avgjg P_avgjg Rprec_mult_avgjg".split(),
}


@dataclass(frozen=True)
class Measure:
    """kind: the type of its parameters (int or float cutoffs, gains, numbers, none); avg: mean, geo, sum or none."""

    name: str
    kind: str
    default: tuple
    avg: str
    build: Callable[..., list[tuple[str, Column]]]


@dataclass(frozen=True)
class Wanted:
    """A measure with its parameters: ``label`` is its name with what was given."""

    measure: Measure
    label: str
    params: tuple


REGISTRY: dict[str, Measure] = {}


def measure(name: str, kind: str = "none", default: tuple = (), avg: str = "mean"):
    def add(build):
        REGISTRY[name] = Measure(name, kind, default, avg, build)
        return build

    return add


def parse_measures(names: tuple[str, ...] | list[str]) -> list[Wanted]:
    """Measures of names, nicknames and ``name.params`` (parameters separated by commas; the first dot splits), each
    once, in order. Cutoffs are sorted and must be positive and different."""
    out: dict[str, Wanted] = {}
    for text in names:
        name, _, given = text.partition(".")
        if name in NICKNAMES:
            for n in NICKNAMES[name]:
                if n in REGISTRY:
                    out.setdefault(n, Wanted(REGISTRY[n], n, REGISTRY[n].default))
            continue
        if name not in REGISTRY:
            raise ValueError(f"unknown measure {name!r}")
        m = REGISTRY[name]
        params, label = m.default, name
        if given:
            parts = given.split(",")
            if m.kind == "int":
                params = tuple(sorted(int(float(p)) for p in parts))
            elif m.kind == "float":
                params = tuple(sorted(float(p) for p in parts))
            elif m.kind == "gains":
                params = tuple((int(a), float(b)) for a, b in (p.split("=") for p in parts))
            else:
                params = tuple(float(p) for p in parts)
            if m.kind in ("int", "float") and (len(set(params)) < len(params) or (m.kind == "int" and min(params) <= 0)):
                raise ValueError(f"cutoffs of {name} must be positive and different")
            if m.kind not in ("int", "float") or name in ("11pt_avg", "relstring"):
                label = f"{name}_{given}"
        out[f"{name}.{given}" if given else name] = Wanted(m, label, params)
    # A measure asked for with parameters replaces its default form.
    given_names = {w.measure.name for k, w in out.items() if "." in k}
    return [w for k, w in out.items() if "." in k or w.measure.name not in given_names]


# Columns of the judged frame. n_rel, n_nonrel, n and the ideal ranking are the same in all rows of a query.
class _Frame:
    """The frame's columns by short names, made once per session (a column needs one)."""

    names = {"R": "n_rel", "NN": "n_nonrel", "nn": "nonrel_above"}

    def __init__(self) -> None:
        self._made: tuple[object, dict[str, Column]] = (None, {})

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        context = SparkContext._active_spark_context
        if self._made[0] is not context:
            self._made = (context, {})
        columns = self._made[1]
        if name not in columns:
            columns[name] = self.c / self.r if name == "Pr" else F.col(self.names.get(name, name))
        return columns[name]


at = _Frame()
first = F.first


def div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def total(v: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(v if where is None else F.when(where, v)), F.lit(0.0))


def hits(k: Column | int) -> Column:
    return F.coalesce(F.max(F.when(at.r <= k, at.c)), F.lit(0))


def share(x: float) -> Column:
    return F.floor(F.lit(x) * at.R + F.lit(0.9))


def precision_at_recall(x: float) -> Column:
    return F.coalesce(F.max(F.when((at.c >= share(x)) & (at.R > 0), at.Pr)), F.lit(0.0))


def rel_ret() -> Column:
    return F.sum(at.is_rel)


def ap_sum() -> Column:
    return total(at.Pr, at.is_rel == 1)


def average_precision() -> Column:
    return div(ap_sum(), first(at.R))


def bpref_value() -> Column:
    return div(total(F.when(at.nn == 0, 1.0).otherwise(F.lit(1.0) - F.try_divide(F.least(at.nn, at.R), F.least(at.NN, at.R))), at.is_rel == 1), first(at.R))


def geo(v: Column) -> Column:
    return F.log(F.greatest(v, F.lit(GEO_FLOOR)))


def set_p() -> Column:
    return div(rel_ret(), F.max(at.n))


def set_r() -> Column:
    return div(rel_ret(), first(at.R))



def one(v: Callable[[], Column]):
    return lambda w: [(w.label, v())]


measure("num_ret", avg="sum")(one(lambda: F.count(at.r)))
measure("num_rel", avg="sum")(one(lambda: first(at.R)))
measure("num_rel_ret", avg="sum")(one(rel_ret))
measure("map")(one(average_precision))
measure("gm_map", avg="geo")(one(lambda: geo(average_precision())))
measure("Rprec")(one(lambda: div(F.coalesce(F.max(F.when(at.r <= at.R, at.c)), F.lit(0)), first(at.R))))
measure("bpref")(one(bpref_value))
measure("recip_rank")(one(lambda: F.coalesce(F.lit(1.0) / F.min(F.when(at.is_rel == 1, at.r)), F.lit(0.0))))
measure("gm_bpref", avg="geo")(one(lambda: geo(bpref_value())))
measure("binG")(one(lambda: div(total(F.lit(1.0) / F.log2(F.lit(2) + at.r - at.c), at.is_rel == 1), first(at.R))))
measure("set_P")(one(set_p))
measure("set_recall")(one(set_r))
measure("set_relative_P")(one(lambda: div(rel_ret(), F.least(F.max(at.n), first(at.R)))))
measure("set_map")(one(lambda: div(rel_ret() * rel_ret(), F.max(at.n) * first(at.R))))
measure("num_nonrel_judged_ret", avg="sum")(one(lambda: F.sum(((F.col("rel") >= 0) & (at.is_rel == 0)).cast("long"))))
measure("yaap")(one(lambda: F.log((ap_sum() + 1) / (first(at.R) - ap_sum() + 1))))


@measure("iprec_at_recall", "float", RECALLS)
def _iprec(w: Wanted):
    return [(f"iprec_at_recall_{x:3.2f}", precision_at_recall(x)) for x in w.params]


@measure("11pt_avg", "float", RECALLS)
def _avg11(w: Wanted):
    return [(w.label, sum((precision_at_recall(x) for x in w.params), F.lit(0.0)) / len(w.params))]


@measure("P", "int", CUTOFFS)
def _p(w: Wanted):
    return [(f"P_{k}", hits(k) / F.lit(float(k))) for k in w.params]


@measure("recall", "int", CUTOFFS)
def _recall(w: Wanted):
    return [(f"recall_{k}", div(hits(k), first(at.R))) for k in w.params]


@measure("relative_P", "int", CUTOFFS)
def _relative(w: Wanted):
    return [(f"relative_P_{k}", div(hits(k), F.least(F.lit(k), first(at.R)))) for k in w.params]


@measure("success", "int", SUCCESS)
def _success(w: Wanted):
    return [(f"success_{k}", F.when(hits(k) > 0, 1.0).otherwise(0.0)) for k in w.params]


@measure("map_cut", "int", CUTOFFS)
def _map_cut(w: Wanted):
    return [(f"map_cut_{k}", div(total(at.Pr, (at.is_rel == 1) & (at.r <= k)), first(at.R))) for k in w.params]


@measure("Rprec_mult", "float", FRACTIONS)
def _rprec_mult(w: Wanted):
    return [(f"Rprec_mult_{x:3.2f}", div(F.coalesce(F.max(F.when(at.r <= share(x), at.c)), F.lit(0)), first(share(x)))) for x in w.params]


@measure("relstring", "int", (10,), avg="none")
def _relstring(w: Wanted):
    rel = F.col("rel")
    sign = F.when(rel == NOT_IN_POOL, "-").when(rel < 0, ".").when(rel > 9, ">").otherwise(rel.cast("string"))
    rows = F.sort_array(F.collect_list(F.when(at.r <= w.params[0], F.struct(at.r.alias("r"), sign.alias("s")))))
    return [(w.label, F.concat(F.lit("'"), F.array_join(F.transform(rows, lambda x: x["s"]), ""), F.lit("'")))]


@measure("infAP")
def _infap(w: Wanted):
    above, e = at.r - 1, INFAP_EPSILON
    inferred = 1 / at.r + (above / at.r) * (F.col("pool_above") / above) * ((at.c - 1 + e) / (at.c - 1 + at.nn + 2 * e))
    return [(w.label, div(total(F.when(at.r == 1, 1.0).otherwise(inferred), at.is_rel == 1), first(at.R)))]


@measure("utility", "numbers", (1.0, -1.0, 0.0, 0.0))
def _utility(w: Wanted, size: int = 0):
    a, b, cc, d = w.params
    return [(w.label, a * rel_ret() + b * (F.max(at.n) - rel_ret()) + cc * (first(at.R) - rel_ret()) + d * (F.lit(size) + rel_ret() - F.max(at.n) - first(at.R)))]


@measure("set_F", "numbers", (1.0,))
def _set_f(w: Wanted):
    x = w.params[0]
    return [(w.label, div((x + 1) * set_p() * set_r(), x * set_p() + set_r()))]


def _gain_columns(tag: str) -> tuple[Column, Column, Column]:
    """Gain of the row, running discounted gain, and the ideal ranking of its query, for one set of gains."""
    return F.col(f"g_{tag}"), F.col(f"dcg_{tag}"), F.col(f"ideal_{tag}")


@measure("ndcg", "gains")
def _ndcg(w: Wanted, tag: str = "0"):
    g, _, ideal = _gain_columns(tag)
    return [(w.label, div(total(g / F.log2(at.r + 1)), first(ideal["idcg"])))]


@measure("ndcg_p", "gains")
def _ndcg_p(w: Wanted, tag: str = "0"):
    g, _, ideal = _gain_columns(tag)
    d = F.when(at.r > 1, g / F.log2(at.r.cast("double"))).otherwise(g)
    return [(w.label, div(total(d), first(ideal["idcg_p"])))]


@measure("ndcg_cut", "int", CUTOFFS)
def _ndcg_cut(w: Wanted, tag: str = "0"):
    g, _, ideal = _gain_columns(tag)
    return [(f"ndcg_cut_{k}", div(total(g / F.log2(at.r + 1), at.r <= k), first(ideal[f"at{k}"]))) for k in w.params]


@measure("ndcg_rel", "gains")
def _ndcg_rel(w: Wanted, tag: str = "0"):
    g, dcg, ideal = _gain_columns(tag)
    here = total(F.try_divide(dcg, F.col(f"idcg_{tag}")), g > 0)
    rest = (first(ideal["npos"]) - F.sum((g > 0).cast("int"))) * div(F.max_by(dcg, at.r), first(ideal["idcg"]))
    return [(w.label, F.coalesce(F.try_divide(here + rest, first(ideal["npos"])), F.lit(0.0)))]


@measure("Rndcg", "gains")
def _rndcg(w: Wanted, tag: str = "0"):
    _, dcg, ideal = _gain_columns(tag)
    at_border = F.aggregate(F.filter(ideal["levels"], lambda b: F.least(b["m"], at.n) == at.r), F.lit(0.0), lambda a, b: a + dcg / b["idcg"])
    after = F.max(at.n) > first(ideal["npos"]) + 1
    s = total(at_border) + F.when(after, div(F.max_by(dcg, at.r), first(ideal["idcg"]))).otherwise(0.0)
    return [(w.label, F.coalesce(F.try_divide(s, F.size(first(ideal["levels"])) + F.when(after, 1).otherwise(0)), F.lit(0.0)))]


@measure("G", "gains")
def _g(w: Wanted, tag: str = "0"):
    g, _, ideal = _gain_columns(tag)
    part = g / F.log2(F.lit(2.0) + F.col(f"cost_{tag}") - F.col(f"gain_{tag}"))
    return [(w.label, div(total(part, g != 0), first(ideal["total"])))]


GAIN_MEASURES = ("ndcg", "ndcg_p", "ndcg_cut", "ndcg_rel", "Rndcg", "G")
RUNNING_GAINS = ("ndcg_rel", "Rndcg", "G")  # those that need the discounted gain at every rank
for _name, _of in (("map_avgjg", "map"), ("P_avgjg", "P"), ("Rprec_mult_avgjg", "Rprec_mult")):
    _m = REGISTRY[_of]
    measure(_name, _m.kind, _m.default)(
        lambda w, _m=_m, _of=_of: [(lab.replace(_of, f"{_of}_avgjg", 1), v) for lab, v in _m.build(Wanted(_m, _of if _m.kind == "none" else w.label, w.params))]
    )
for _name in NICKNAMES["all_prefs"][2:]:  # computed from preference pairs
    measure(_name, avg="sum" if "num_prefs" in _name else "mean")(lambda w: [])
for _name in ("runid", "num_q"):  # of the whole run
    measure(_name, avg="none")(lambda w: [])

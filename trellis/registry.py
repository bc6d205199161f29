"""Queries and their SQL, by name. A query without SQL is covered by tests of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions import expr as X
from trellis.operators import along_tree, batch, clusters, curves, embed, expression, integrate, layout, markers, neighbors, pseudotime, stages, tree, views, walks
from trellis.plans import fixtures as fx
from trellis.plans.fixtures import SQL, created_sql
from trellis.plans.scratch import Scratch
from trellis.sources import ingest

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


def _scratch(spark: SparkSession, name: str) -> Scratch:
    return Scratch(spark, f"{name}-{uuid.uuid4().hex}")


def _created(spark: SparkSession, sf_dir: str) -> ingest.Container:
    return ingest.create(fx.customer_counts(spark, sf_dir), min_cells=3, min_genes=3, min_counts=10, gene_max_cut=100000, scratch=_scratch(spark, "container"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("grp"))


def _sides(spark: SparkSession, sf_dir: str, c: ingest.Container) -> DataFrame:
    """Every segment of customers against all others."""
    return _scratch(spark, "sides").table(markers.one_against_rest(c.cells.select("cell").join(_segments(spark, sf_dir), "cell")), "sides")


CREATED = created_sql("m2", 3, 3, 10, 100000)


@query(f"with {created_sql('m1', 3, 100, 10, 5000)} select gene, cell, value from ex")
def create_filter_normalize(spark, sf_dir):
    return ingest.create(fx.supplier_counts(spark, sf_dir), min_genes=100, scratch=_scratch(spark, "container")).expr


@query(f"with {created_sql('m1', 3, 100, 10, 5000)} select cell, n_genes::bigint n_genes, n_trans from tot")
def cell_metadata(spark, sf_dir):
    return ingest.create(fx.supplier_counts(spark, sf_dir), min_genes=100).cells


SIDES = "sd as (select cmp, tot.cell, case when c_mktsegment = cmp then 1 else 2 end side from tot join customer on c_custkey::varchar = tot.cell, (select distinct c_mktsegment cmp from customer))"


@query(f"""with {CREATED}, {SIDES}, z as (select cmp, count(*) filter (side = 1) n1, count(*) filter (side = 2) n2 from sd group by 1), mt as (select ex.*, cmp, side from ex join sd using (cell)),
u as (select cmp, gene, n1, n2, coalesce(sum(power(2, value) - 1) filter (side = 1), 0) u1, coalesce(sum(power(2, value) - 1) filter (side = 2), 0) u2, count(*) filter (side = 1 and value > 0) k1, count(*) filter (side = 2 and value > 0) k2 from mt join z using (cmp) group by all),
g as (select cmp, gene, n1, n2, round(k1 / n1, 3) frac_1, round(k2 / n2, 3) frac_2, round(log2(u1 / n1 + 1), 3) exp_1, round(log2(u2 / n2 + 1), 3) exp_2 from u where n1 > 0 and n2 > 0),
f as (select *, case when exp_2 = 0 and exp_1 > 0 then 'infinity'::double when exp_1 > 0 then log2((power(2, exp_1) - 1) / (power(2, exp_2) - 1)) end exp_fc from g),
p as (select * from f where greatest(frac_1, frac_2) > 0.1 and abs(frac_1 - frac_2) > 0 and exp_fc > 0),
r as (select cmp, gene, value, count(*) filter (side = 1) p, count(*) filter (side = 2) n from mt semi join p using (cmp, gene) where value <> 0 group by 1, 2, 3),
al as (select * from r union all select cmp, gene, 0, n1 - coalesce(sp, 0), n2 - coalesce(sn, 0) from p left join (select cmp, gene, sum(p) sp, sum(n) sn from r group by 1, 2) using (cmp, gene) where n1 - coalesce(sp, 0) + n2 - coalesce(sn, 0) > 0),
c as (select cmp, gene, value, sum(p) over w / sum(p) over (partition by cmp, gene) rec, sum(p) over w / (sum(p) over w + sum(n) over w) prec from al window w as (partition by cmp, gene order by value desc)),
st as (select cmp, gene, (rec - lag(rec) over w) * (prec + lag(prec) over w) / 2 s from c window w as (partition by cmp, gene order by value desc)),
au as (select cmp, gene, round(coalesce(sum(s), 0), 3) auc from st group by 1, 2)
select cmp, gene, frac_1, frac_2, exp_1, exp_2, round(exp_fc, 6) exp_fc, auc, round(auc / (n1 / (n1 + n2)), 6) ratio from p join au using (cmp, gene) where auc >= least(n1 / (n1 + n2), 1)""")
def markers_auc_pr(spark, sf_dir):
    c = _created(spark, sf_dir)
    out = markers.markers_auc_pr(c.expr, _sides(spark, sf_dir, c), effect=0.0)
    return out.withColumns({"exp_fc": F.round("exp_fc", 6), "ratio": F.round("ratio", 6)})


def _binom_sql(sd: str, frac: str, genes: str = "(select distinct gene from ex)", x: str = "") -> str:
    """CTEs ending in ``bi``: the binomial test in both directions over (cmp, cell, side) of ``sd``; names end in ``x``.
    The upper tail is a sum of its terms."""
    tail = lambda k, n, q: f"case when {k} <= 0 or {q} >= 1 then 1 else list_sum(list_transform(range({k}, {n} + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({q}) + ({n} - j) * ln(1 - ({q}))))) end"
    return f"""z{x} as (select cmp, count(*) filter (side = 1) n1, count(*) filter (side = 2) n2 from {sd} group by 1),
kk{x} as (select cmp, gene, count(*) filter (side = 1) k1, count(*) filter (side = 2) k2 from ex join {sd} using (cell) where value > 0 group by 1, 2),
tt{x} as (select cmp, gene, coalesce(sum(count) filter (side = 1), 0) t1, coalesce(sum(count) filter (side = 2), 0) t2 from kp join {sd} using (cell) group by 1, 2),
gg{x} as (select cmp, gene, n1, n2, coalesce(k1, 0) k1, coalesce(k2, 0) k2, coalesce(t1, 0) t1, coalesce(t2, 0) t2 from {genes} cross join z{x} left join kk{x} using (cmp, gene) left join tt{x} using (cmp, gene) where n1 > 0 and n2 > 0),
q{x} as (select *, least(greatest(k2, 1) / n2, 1) q2, least(greatest(k1, 1) / n1, 1) q1 from gg{x}),
pv{x} as materialized (select *, 1 dir, {tail("k1", "n1", "q2")} p from q{x} union all select *, -1, {tail("k2", "n2", "q1")} from q{x}),
ad{x} as (select *, least(1, min(p * m / r) over (partition by cmp, dir order by r rows between current row and unbounded following)) p_adj from (select *, row_number() over (partition by cmp, dir order by p) r, count(*) over (partition by cmp, dir) m from pv{x})),
le{x} as (select *, case when k1 > 0 and k2 > 0 then ln(k1 * n2 / (k2 * n1)) when k1 > 0 then 'inf'::double when k2 > 0 then '-inf'::double end log_effect, round(k1 / n1, 3) frac_1, round(k2 / n2, 3) frac_2, round(t1 / n1, 3) trans_1, round(t2 / n2, 3) trans_2 from ad{x}),
bi{x} as (select cmp, gene, p_adj, log_effect, frac_1, frac_2, trans_1, trans_2 from le{x} where log_effect * dir >= 0 and {frac})"""


@query(f"with {CREATED}, {SIDES}, {_binom_sql('sd', 'frac_1 >= 0.1')} select cmp, gene, round(p_adj, 8) p_adj, round(log_effect, 6) log_effect, frac_1, frac_2, trans_1, trans_2 from bi")
def markers_binomial(spark, sf_dir):
    c = _created(spark, sf_dir)
    out = markers.markers_binom(c.expr, c.counts, _sides(spark, sf_dir, c), effect=0.0, p_max=1.0, either=False)
    return out.withColumns({"p_adj": F.round("p_adj", 8), "log_effect": F.round("log_effect", 6)})


def _welch(spark, sf_dir):
    c = _created(spark, sf_dir)
    return markers.welch(c.expr.select(F.col("gene").alias("name"), "cell", F.col("value").alias("v")), _sides(spark, sf_dir, c), 1.0, 0.0)


@query()
def markers_welch(spark, sf_dir):
    return _welch(spark, sf_dir).drop("t", "df")


WELCH = """z as (select cmp, count(*) filter (side = 1) n1, count(*) filter (side = 2) n2 from sd group by 1),
su as (select cmp, gene, coalesce(sum(value) filter (side = 1), 0) s1, coalesce(sum(value * value) filter (side = 1), 0) q1, coalesce(sum(value) filter (side = 2), 0) s2, coalesce(sum(value * value) filter (side = 2), 0) q2 from ex join sd using (cell) group by 1, 2),
mo as (select cmp, gene, n1, n2, s1 / n1 m1, s2 / n2 m2, case when q1 - s1 * s1 / n1 > 1e-12 * q1 then (q1 - s1 * s1 / n1) / (n1 - 1) else 0 end / n1 a, case when q2 - s2 * s2 / n2 > 1e-12 * q2 then (q2 - s2 * s2 / n2) / (n2 - 1) else 0 end / n2 b from su join z using (cmp) where n1 > 1 and n2 > 1),
wl as (select cmp, gene as name, m1, m2, (m1 - m2) / sqrt(a + b) t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) df, case when m1 > 0 and m2 > 0 then ln(m1 / m2) when m1 > 0 then 'inf'::double when m2 > 0 then '-inf'::double end log_fc from mo where a + b > 0)"""


@query(f"with {CREATED}, {SIDES}, {WELCH} select cmp, name, round(m1, 6) m1, round(m2, 6) m2, round(log_fc, 6) log_fc, round(t, 5) t, round(df, 4) df from wl")
def welch_statistics(spark, sf_dir):
    return _welch(spark, sf_dir).select("cmp", "name", *[F.round(c, n).alias(c) for c, n in (("m1", 6), ("m2", 6), ("log_fc", 6), ("t", 5), ("df", 4))])


@query(f"""with {SQL['e1']} select c1.grp, gene, round(log2(sum(power(2, value) - 1) / any_value(n) + 1), 6) mean_of_logs, round(sum(value) / any_value(n), 6) as mean, round(count(*) / any_value(n), 6) prop_exp
from c1 join sz on sz.grp = c1.grp group by 1, 2""")
def summary_by_cluster(spark, sf_dir):
    s = expression.summary_by_group(fx.clamped(spark, sf_dir), fx.vectors(spark, sf_dir).select("cell", "grp"))
    return s.select("grp", "gene", *[F.round(c, 6).alias(c) for c in ("mean_of_logs", "mean", "prop_exp")])


@query(f"""with {SQL['e1']}, ce as (select grp, g, avg(v) m from e1 group by 1, 2), d as (select a.grp, b.grp other, sqrt(sum((a.m - b.m) * (a.m - b.m))) d from ce a join ce b on a.g = b.g and a.grp <> b.grp group by 1, 2)
select grp, arg_min(other, d) nearest, round(min(d), 6) dist from d group by 1""")
def nearest_cluster(spark, sf_dir):
    long = fx.vectors(spark, sf_dir).select("grp", F.posexplode("vec").alias("g", "v"))
    m = long.groupBy("grp", "g").agg(F.avg("v").alias("m"))
    d = m.join(m.toDF("other", "g", "m2"), "g").where("grp <> other").groupBy("grp", "other").agg(F.sqrt(F.sum(F.pow(F.col("m") - F.col("m2"), 2.0))).alias("d"))
    return d.groupBy("grp").agg(F.min_by("other", "d").alias("nearest"), F.round(F.min("d"), 6).alias("dist"))


KNN = "v as (select vec_id, embedding::double[] e from embeddings), kd as (select a.vec_id cell, b.vec_id nbr, list_distance(a.e, b.e) dist from v a join v b on a.vec_id <> b.vec_id), kn as (select *, row_number() over (partition by cell order by dist, nbr) rank from kd qualify rank <= 20)"


def _knn(spark, sf_dir, k: int = 20):
    return neighbors.knn_exact(fx.vectors(spark, sf_dir), k, _scratch(spark, "knn"))


@query(f"with {KNN} select cell, rank::int rank, nbr, round(dist, 6) dist from kn")
def knn_exact(spark, sf_dir):
    return _knn(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"with {KNN}, d as (select cell, max(dist) filter (rank = 1) d1, max(dist) filter (rank = 20) d2 from kn group by 1) select cell from d where d1 > 1.2 or d2 > 0.4 + d1 or d2 > 1.0 + 0.3 * d1")
def knn_outliers(spark, sf_dir):
    return neighbors.knn_outliers(_knn(spark, sf_dir), 1, 20, 1.2, 1.0, 0.4, 0.3, 1.0)


@query(f"""with {KNN}, n as (select * from kn where rank <= 10), e as (select distinct least(cell, nbr) a, greatest(cell, nbr) b from n),
s as (select e.a, e.b, count(*) i from e join n x on x.cell = e.a join n y on y.cell = e.b and y.nbr = x.nbr group by 1, 2), w as (select a, b, i / (20 - i) w from s)
select a, b, round(w / (select max(w) from w), 6) w from w""")
def jaccard_edges(spark, sf_dir):
    return neighbors.jaccard_edges(_knn(spark, sf_dir, 10), 10).withColumn("w", F.round("w", 6))


def _jaccard(spark, sf_dir):
    return _scratch(spark, "jaccard").table(neighbors.jaccard_edges(_knn(spark, sf_dir, 10), 10), "edges")


@query()
def graph_clusters(spark, sf_dir):
    return clusters.communities(_jaccard(spark, sf_dir), _scratch(spark, "clusters"))


@query()
def graph_clusters_codelength(spark, sf_dir):
    return clusters.communities(_jaccard(spark, sf_dir), _scratch(spark, "clusters"), method="codelength")


JACCARD = f"{KNN}, n as (select * from kn where rank <= 10), je as (select distinct least(cell, nbr) a, greatest(cell, nbr) b from n), js as (select je.a, je.b, count(*) i from je join n x on x.cell = je.a join n y on y.cell = je.b and y.nbr = x.nbr group by 1, 2), jw as (select a, b, i / (20 - i) w from js), jr as (select a, b, w / (select max(w) from jw) w from jw)"


@query(f"""with {JACCARD}, la as (select vec_id cell, label c from embeddings), en as (select p.cell v, p.c, w, p.c = q.c same from jr join la p on p.cell = a join la q on q.cell = b union all select q.cell, q.c, w, p.c = q.c from jr join la p on p.cell = a join la q on q.cell = b),
m as (select sum(w) m2 from en), no as (select sum(d / m2 * log2(d / m2)) node from (select v, sum(w) d from en group by 1), m), gr as (select c, sum(w) / any_value(m2) p, sum(w) filter (same) / any_value(m2) inn from en, m group by 1),
qs as (select sum(coalesce(inn, 0) - p * p) modularity, sum(p - coalesce(inn, 0)) q, sum(case when p - coalesce(inn, 0) > 1e-12 then (p - coalesce(inn, 0)) * log2(p - coalesce(inn, 0)) else 0 end) ql, sum((2 * p - coalesce(inn, 0)) * log2(2 * p - coalesce(inn, 0))) pl, count(*) clusters from gr)
select round(modularity, 6) modularity, round(case when q > 0 then q * log2(q) else 0 end - 2 * ql - node + pl, 6) codelength, clusters from qs, no""")
def cluster_quality(spark, sf_dir):
    labels = fx.vectors(spark, sf_dir).select("cell", F.col("grp").alias("cluster"))
    return clusters.quality(_jaccard(spark, sf_dir), labels).withColumns({"modularity": F.round("modularity", 6), "codelength": F.round("codelength", 6)})


@query(f"""with {SQL['e1']}, k as (select count(*) n from embeddings), s as (select gene, sum(value) s, sum(value * value) q from c1 group by 1),
m as (select gene, s / n mu, sqrt((q - s * s / n) / (n - 1)) sd from s, k), d as (select vec_id cell, gene from embeddings, (select distinct gene from c1))
select d.cell, d.gene, round((coalesce(value, 0) - mu) / sd, 5) z from d join m using (gene) left join c1 on c1.cell = d.cell and c1.gene = d.gene""")
def dense_zscore(spark, sf_dir):
    e = fx.clamped(spark, sf_dir)
    return expression.z_scores(e, fx.vectors(spark, sf_dir).select("cell")).select("cell", "gene", F.round("z", 5).alias("z"))


@query(f"""with {SQL['m1']}, k as (select count(distinct cell) n from m1), s as (select gene, sum(count) s, sum(count * count) q from m1 group by 1)
select gene, round(s / n, 6) as mean, round(sqrt((q - s * s / n) / (n - 1)) / (s / n), 6) cv from s, k""")
def variable_gene_stats(spark, sf_dir):
    c = fx.supplier_counts(spark, sf_dir)
    return neighbors.variable_gene_stats(c, c.select("cell").distinct()).select("gene", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


def _digamma(x: str) -> str:
    """By recurrence to twelve above and the asymptotic series there."""
    y = f"({x} + 12)"
    shifted = " - ".join(f"1 / ({x} + {i})" for i in range(12))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * power({y}, 4)) - 1 / (252 * power({y}, 6)) - {shifted})"


@query(f"""with recursive {SQL['m1']}, k as (select count(distinct cell) n from m1), s as (select gene, sum(count) s, sum(count * count) q from m1 group by 1), st as (select gene, s / n mean, sqrt((q - s * s / n) / (n - 1)) / (s / n) cv from s, k),
to2 as (select cell, sum(count)::double t from m1 group by 1), ra as (select avg(t / m) mean, avg(ln(t / m)) lg from to2, (select avg(t) m from to2)), s0 as (select mean, ln(mean) - lg s from ra),
ga as (select (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) a, s, mean, 0 k from s0 union all select greatest(a - (ln(a) - {_digamma('a')} - s) / (1 / a - ({_digamma('(a * 1.00001)')} - {_digamma('(a * 0.99999)')}) / (2e-5 * a)), a / 2), s, mean, k + 1 from ga where k < 50),
sh as (select a, a / mean rate from ga where k = 50), d as (select gene, st.mean, cv, ln(cv) - ln(sqrt(a * st.mean / rate + a * power(st.mean / rate, 2)) / (a * st.mean / rate)) diff_cv from st, sh)
select gene, round(mean, 6) as mean, round(cv, 6) cv, round(diff_cv, 5) diff_cv from d where diff_cv > 0 and mean > 0.005""")
def variable_genes(spark, sf_dir):
    c = fx.supplier_counts(spark, sf_dir)
    out = neighbors.variable_genes(c, c.select("cell").distinct(), cutoff=0.0, mean_max=1e9)
    return out.withColumns({"mean": F.round("mean", 6), "cv": F.round("cv", 6), "diff_cv": F.round("diff_cv", 5)})


@query()
def principal_components(spark, sf_dir):
    e = fx.vectors(spark, sf_dir).select("cell", F.posexplode("vec").alias("gene", "value")).withColumn("gene", F.col("gene").cast("string"))
    return neighbors.pca(expression.z_scores(e, fx.vectors(spark, sf_dir).select("cell")))[0]


PAIRS = f"""{SQL['e1']}, f as (select cell, gene m, (value >= 0.2)::int h from c1 where value >= 0.1), s as (select m, sum(h) nh, count(*) nl from f group by 1),
o as (select a.m m1, b.m m2, sum(a.h * b.h) oh, count(*) ol from f a join f b on a.cell = b.cell and a.m < b.m group by 1, 2),
pr as (select a.m m1, b.m m2, coalesce(oh, 0) oh, coalesce(ol, 0) ol, round_even(coalesce(coalesce(oh, 0) / nullif(least(a.nh, b.nh), 0), 0), 4) fh, round_even(coalesce(coalesce(ol, 0) / nullif(least(a.nl, b.nl), 0), 0), 4) fl from s a join s b on a.m < b.m left join o on o.m1 = a.m and o.m2 = b.m)"""


def _modules(spark, sf_dir):
    return fx.clamped(spark, sf_dir).select("cell", F.col("gene").alias("module"), F.col("value").alias("v"))


@query(f"with {PAIRS} select m1, m2, oh::bigint overlap_high, ol::bigint overlap_low, fh frac_high, fl frac_low, round_even(fl - fh, 4) frac_diff from pr")
def doublet_module_pairs(spark, sf_dir):
    return expression.doublet_pairs(_modules(spark, sf_dir), 0.2, 0.1)


@query(f"with {PAIRS}, k as (select m1, m2 from pr where fh <= 0.15 and round_even(fl - fh, 4) <= 0.3) select distinct a.cell from c1 a join c1 b on a.cell = b.cell join k on k.m1 = a.gene and k.m2 = b.gene where a.value >= 0.25 and b.value >= 0.25")
def doublet_cells(spark, sf_dir):
    m = _modules(spark, sf_dir)
    return expression.doublet_cells(m, expression.doublet_pairs(m, 0.2, 0.1), 0.25, 0.15, 0.3)


HOPS = f"{SQL['w1']}, ln as (select walk, max(pos) len from w1 group by 1), hp as (select w1.*, pos / len hop from w1 join ln using (walk))"


@query(f"with {HOPS} select cell, count(*) visits, round(avg(hop), 6) pseudotime, round(log10(count(*) + 1), 6) visits_log from hp group by 1")
def walk_positions(spark, sf_dir):
    return pseudotime.process_walks(fx.walks(spark, sf_dir)).select("cell", "visits", F.round("pseudotime", 6).alias("pseudotime"), F.round("visits_log", 6).alias("visits_log"))


PREFIX = f"{HOPS}, nr as (select walk, dense_rank() over (order by walk) nr from (select distinct walk from w1)), ct as (select distinct ceil(i / 10 * n)::int c from range(1, 11) r(i), (select count(*) n from nr)), px as (select c n_walks, cell, count(*) visits, avg(hop) pt from hp join nr using (walk), ct where nr <= c group by 1, 2)"


@query(f"with {PREFIX} select n_walks::int n_walks, cell, visits, round(pt, 6) pseudotime from px")
def walk_visits_prefix(spark, sf_dir):
    return pseudotime.walk_prefixes(fx.walks(spark, sf_dir), _scratch(spark, "prefixes")).withColumn("pseudotime", F.round("pseudotime", 6))


@query(f"with {PREFIX}, d as (select n_walks, abs(pt - lag(pt) over (partition by cell order by n_walks)) d from px) select n_walks::int n_walks, round(sum(d), 6) as change from d group by 1")
def stability_total_change(spark, sf_dir):
    return pseudotime.stability_change(pseudotime.walk_prefixes(fx.walks(spark, sf_dir), _scratch(spark, "prefixes"))).withColumn("change", F.round("change", 6))


PT = f"{HOPS}, pt as (select cell, avg(hop) pt from hp group by 1)"
PARAMS = f"{PT}, lg as (select pt - lead(pt, 4) over w b, lead(pt, 2) over w - pt f from pt window w as (order by pt desc, cell)), pa as (select avg(b) b, avg(f) f from lg), lp as (select b, f, (b + f) / 2 x0, ln(0.01) / ((b + f) / 2 - f) k from pa)"
STEPS = "st as (select cell i, lead(cell) over (partition by walk order by pos) j from w1), ed as (select i, j, count(*)::double w from st where j is not null group by 1, 2)"


def _pt(spark, sf_dir):
    return pseudotime.process_walks(fx.walks(spark, sf_dir))


def _steps(spark, sf_dir):
    w = fx.walks(spark, sf_dir).select(F.col("cell").alias("i"), F.lead("cell").over(W.partitionBy("walk").orderBy("pos")).alias("j"))
    return w.where("j is not null").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))


@query(f"with {PARAMS} select round(b, 8) back, round(f, 8) forward, round(x0, 8) x0, round(k, 5) k from lp")
def logistic_params(spark, sf_dir):
    p = pseudotime.logistic_params(_pt(spark, sf_dir), 2, 4, _scratch(spark, "order"))
    return p.select(*[F.round(c, 8).alias(c) for c in ("back", "forward", "x0")], F.round("k", 5).alias("k"))


def _weighted(spark, sf_dir):
    pt = _pt(spark, sf_dir)
    return pseudotime.weighted_edges(_steps(spark, sf_dir), pt, pseudotime.logistic_params(pt, 2, 4, _scratch(spark, "order")))


@query(f"with {PARAMS}, {STEPS} select i, j, round(w / (1 + exp(-k * (b.pt - a.pt - x0))), 6) w from ed join pt a on a.cell = i join pt b on b.cell = j, lp")
def weighted_edges(spark, sf_dir):
    return _weighted(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(f"with {SQL['w1']}, {STEPS}, rs as (select i, sum(w) s from ed group by 1) select i, j, round(w / (select max(s) from rs), 8) w from ed")
def flood_matrix(spark, sf_dir):
    return pseudotime.flood_matrix(_steps(spark, sf_dir)).withColumn("w", F.round("w", 8))


@query(f"""with {SQL['w1']}, f as (select walk sim, cell, min(pos) - 1 step from w1 group by 1, 2), k as (select count(distinct sim) n from f), ok as (select cell from f, k group by cell having 1 - count(*) / any_value(n) <= 0.9),
t as (select sim, max(step) t from f group by 1) select cell, round(avg(step / t), 6) pseudotime, count(step / t) visits, round(log10(count(step / t) + 1), 6) visits_log from f join t using (sim) semi join ok using (cell) group by 1""")
def flood_normalize(spark, sf_dir):
    f = fx.walks(spark, sf_dir).groupBy(F.col("walk").alias("sim"), "cell").agg((F.min("pos") - 1).alias("step"))
    return pseudotime.process_floods(f, max_missing=0.9)[0].select("cell", F.round("pseudotime", 6).alias("pseudotime"), "visits", F.round("visits_log", 6).alias("visits_log"))


def _earliest(spark, sf_dir, n: int) -> list:
    return [r["cell"] for r in _pt(spark, sf_dir).orderBy("pseudotime", "cell").limit(n).collect()]


@query(f"""with {PT}, {STEPS}, ro as (select cell from pt order by pt, cell limit 12), fl as (select i, j, w / (select max(s) from (select sum(w) s from ed group by i)) w from ed)
select i cell, round(1 - exp(sum(ln(1 - w))), 8) chance from fl join ro on ro.cell = j where i not in (select cell from ro) and w > 0 group by 1""")
def flood_chances(spark, sf_dir):
    e = pseudotime.flood_matrix(_steps(spark, sf_dir))
    roots = spark.createDataFrame([(r,) for r in _earliest(spark, sf_dir, 12)], "cell string")
    return pseudotime.flood_chances(e, roots).withColumn("chance", F.round("chance", 8))


@query()
def flood_simulation(spark, sf_dir):
    e = pseudotime.flood_matrix(_steps(spark, sf_dir))
    return pseudotime.flood(e, _earliest(spark, sf_dir, 12), 50, _scratch(spark, "flood"))


@query()
def biased_walks(spark, sf_dir):
    pt, scratch = _pt(spark, sf_dir), _scratch(spark, "walks")
    last = [r["cell"] for r in pt.orderBy(F.desc("pseudotime"), F.desc("cell")).limit(6).collect()]
    tips = spark.createDataFrame([("a", c) for c in last[:3]] + [("b", c) for c in last[3:]], "tip string, cell string")
    made = walks.random_walks(scratch.table(_weighted(spark, sf_dir), "edges"), tips, _earliest(spark, sf_dir, 3), 5000, scratch, order=pt.select("cell", "pseudotime"))
    return pseudotime.process_walks(made, ["tip"])


UP = f"{SQL['t1']}, up as (select child segment, parent ancestor, 1 depth from t1 union all select up.segment, t1.parent, depth + 1 from up join t1 on t1.child = up.ancestor)"


@query(f"with recursive {UP} select segment, ancestor, depth from up")
def segment_parents_all(spark, sf_dir):
    return tree.ancestors(fx.tree(spark, sf_dir))


@query(f"with recursive {UP} select ancestor, segment as descendant from up")
def children_all(spark, sf_dir):
    return tree.ancestors(fx.tree(spark, sf_dir)).select("ancestor", F.col("segment").alias("descendant"))


@query(f"with {SQL['t1']} select a.child segment, b.child sibling from t1 a join t1 b on a.parent = b.parent and a.child <> b.child")
def siblings(spark, sf_dir):
    return tree.siblings(fx.tree(spark, sf_dir), include_self=False)


@query(f"with {SQL['t1']} select distinct child segment from t1 where child not in (select parent from t1)")
def terminals(spark, sf_dir):
    return tree.terminals(fx.tree(spark, sf_dir))


@query(f"""with recursive {UP}, ch as (select ancestor s from up where segment in ('s3', 's7') and ancestor <> 'world' union select unnest(['s3', 's7']))
select c_custkey cell from customer where 'n' || c_nationkey in (select s from ch)""")
def cells_along_lineage(spark, sf_dir):
    cells = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("segment"))
    return tree.cells_along_lineage(fx.tree(spark, sf_dir), cells, ["s3", "s7"])


VISITS = f"{SQL['w1']}, vs as (select 's' || (walk % 3) segment, cell, count(*) v from w1 group by 1, 2)"


def _visits(spark, sf_dir):
    return fx.walks(spark, sf_dir).groupBy(F.concat(F.lit("s"), (F.col("walk") % 3).cast("string")).alias("segment"), "cell").agg(F.count("*").alias("v"))


@query(f"with {VISITS}, t as (select *, max(v) over (partition by cell) top from vs) select cell, segment from t where top >= 10 and v >= 0.7 * top")
def segment_membership(spark, sf_dir):
    return tree.membership(_visits(spark, sf_dir), 10, 0.7)


EQUAL = f"{SQL['w1']}, nn as (select walk, pos, cell, count(*) over (partition by walk) m from w1), nk as (select *, greatest(round_even(m / 20, 0), 1) n from nn), ng as (select walk, pos, cell, (select count(*) from range(1, n::int + 1) r(g) where round_even(m / n * g, 0) < pos) + 1 grp from nk)"


@query(f"with {EQUAL} select walk, pos::int pos, cell, grp::int grp from ng")
def near_equal_nodes(spark, sf_dir):
    return tree.near_equal(fx.walks(spark, sf_dir), ["walk"], ["pos"], 20)


@query(f"with {EQUAL}, tp as (select walk, max(grp) top from ng group by 1) select walk, s::int as window, count(*) n from ng join tp using (walk), range(1, 100) r(s) where s <= top - 2 + 1 and grp between s and s + 1 group by 1, 2")
def moving_windows(spark, sf_dir):
    g = tree.near_equal(fx.walks(spark, sf_dir), ["walk"], ["pos"], 20)
    return tree.moving_windows(g, 2, ["walk"]).groupBy("walk", "window").agg(F.count("*").alias("n"))


TIMED = "tw as (select vec_id cell, embedding[1]::double pt from embeddings), tr as (select min(pt) lo, max(pt) hi, greatest(round_even((max(pt) - min(pt)) / 0.05, 0), 1)::int n from tw), tg as (select cell, pt, n, least(greatest(ceil((pt - lo) * n / (hi - lo)), 1), n)::int grp from tw, tr)"


def _by_dimension(spark, sf_dir):
    return fx.vectors(spark, sf_dir).select("cell", F.get("vec", 0).alias("pseudotime"))


@query(f"with {TIMED} select s::int as window, count(*) n, round(avg(pt), 3) as name from tg, range(1, 1000) r(s) where s <= (select max(grp) from tg) - 3 + 1 and grp between s and s + 2 group by 1")
def windows_of_time(spark, sf_dir):
    w = tree.moving_windows(tree.equal_times(_by_dimension(spark, sf_dir), 0.05), 3)
    return w.groupBy("window").agg(F.count("*").alias("n")).join(tree.window_names(w), "window")


@query("""with tw as (select vec_id cell, embedding[1]::double pt from embeddings), q as (select *, row_number() over (order by pt, cell) r, count(*) over () m from tw), nw as (select *, greatest(round_even(m / 20, 0), 1) n from q), g as (select *, (select count(*) from range(1, n::int + 1) x(g) where round_even(m / n * g, 0) < r) + 1 grp from nw),
w as (select s win, cell, pt from g, range(1, 1000) x(s) where s <= (select max(grp) from g) - 2 and grp between s and s + 2), nm as (select win, floor(round(avg(pt), 3) / 0.1)::int t from w group by 1)
select t::int as window, cell, round(pt, 6) pseudotime from (select distinct t, cell, pt from w join nm using (win))""")
def windows_merged(spark, sf_dir):
    grouped = tree.near_equal(_by_dimension(spark, sf_dir), [], ["pseudotime", "cell"], 20, scratch=_scratch(spark, "order"))
    return tree.merged_windows(tree.moving_windows(grouped, 3), 0.1).withColumn("pseudotime", F.round("pseudotime", 6))


@query(f"with {SQL['e1']} select c1.grp, gene, round(log2(sum(power(2, value) - 1) / count(*) + 1), 6) as mean, round(count(*) / any_value(n), 6) prop_exp from c1 join sz on sz.grp = c1.grp group by 1, 2 having count(*) / any_value(n) >= 0.4")
def dot_values(spark, sf_dir):
    out = expression.dot_values(fx.clamped(spark, sf_dir).select("cell", "gene", "value"), fx.vectors(spark, sf_dir).select("cell", "grp"), 0.4, expressing_only=True)
    return out.withColumns({"mean": F.round("mean", 6), "prop_exp": F.round("prop_exp", 6)})


@query(f"with {SQL['m2']} select c_custkey::varchar cell, round(log2(coalesce(count, 0) + 1), 6) as value from customer left join m2 on m2.cell = c_custkey::varchar and gene = 'Brand#12'")
def plotted_counts(spark, sf_dir):
    cells = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell"), "c_acctbal")
    data, _ = views.plot_data({"meta": cells, "counts": fx.customer_counts(spark, sf_dir)}, cells, "Brand#12")
    return data.withColumn("value", F.round("value", 6))


@query("""with p as (select p_partkey k, (p_partkey % 97 + 1) / 200 p, row_number() over (order by (p_partkey % 97 + 1) / 200, p_partkey) r, count(*) over () n from part)
select k, p, round(least(1, min(p * n / r) over (order by r rows between current row and unbounded following)), 8) p_adj from p""")
def bh_adjust(spark, sf_dir):
    p = fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 97 + 1) / 200).alias("p"))
    return markers.adjust_bh(p, "p", scratch=_scratch(spark, "order")).withColumn("p_adj", F.round("p_adj", 8))


@query("""with p as (select p_partkey k, (p_partkey % 97 + 1) / 2e6 p, row_number() over (order by (p_partkey % 97 + 1) / 2e6, p_partkey) r, count(*) over () n from part)
select k, p, round(least(1, max(p * (n - r + 1)) over (order by p)), 7) p_adj from p""")
def holm_adjust(spark, sf_dir):
    p = fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 97 + 1) / 2e6).alias("p"))
    return markers.adjust_holm(p, "p", scratch=_scratch(spark, "order")).withColumn("p_adj", F.round("p_adj", 7))


@query("select vec_id cell, (embedding[1]::double > 0 and embedding[1]::double < 0.3)::int::varchar || (embedding[2]::double > -0.1 and embedding[2]::double < 0.1)::int::varchar bits from embeddings")
def label_threshold_bits(spark, sf_dir):
    d = fx.vectors(spark, sf_dir).select("cell", F.get("vec", 0).alias("a"), F.get("vec", 1).alias("b"))
    return expression.threshold_bits(d, [("a", 0.0, 0.3), ("b", -0.1, 0.1)]).select("cell", "bits")


@query("select vec_id cell from embeddings where label in (1, 3) and embedding[1]::double between 0 and 0.2")
def which_cells(spark, sf_dir):
    d = fx.vectors(spark, sf_dir).withColumn("x", F.get("vec", 0))
    return d.where(F.col("grp").isin("1", "3") & expression.between("x", 0.0, 0.2)).select("cell")


@query("select c_custkey cell from customer where c_mktsegment = 'BUILDING' and c_nationkey % 5 = 2")
def highlight_intersect(spark, sf_dir):
    c = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).cast("string").alias("rest"))
    return expression.highlight(c.unpivot("cell", ["segment", "rest"], "name", "value"), [("segment", "BUILDING"), ("rest", "2")])


@query(f"with {SQL['m1']}, t as (select cell, sum(count) n from m1 group by 1) select cell as key, row_number() over (order by n desc, cell) rank, round(sum(n) over (order by n desc, cell rows unbounded preceding) / sum(n) over (), 6) share from t")
def read_knee_curve(spark, sf_dir):
    t = fx.supplier_counts(spark, sf_dir).groupBy("cell").agg(F.sum("count").alias("n"))
    return ingest.knee_curve(t, "cell", "n", _scratch(spark, "knee")).withColumn("share", F.round("share", 6))


@query("select o_orderkey barcode, list_aggregate(list_transform(range(15, -1, -1), lambda k: substr('ACGT', ((o_orderkey * 2654435) >> (2 * k)::int & 3)::int + 1, 1)), 'string_agg', '') cell from orders")
def decode_barcode(spark, sf_dir):
    o = fx.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("barcode"), (F.col("o_orderkey") * 2654435).alias("x"))
    return o.select("barcode", X.decode_barcode("x").alias("cell"))


MATH = "select l_orderkey, l_linenumber, l_quantity x, l_extendedprice / 1000 y, l_discount p from lineitem"


@query(f"""with m as ({MATH}) select l_orderkey, l_linenumber, x, y, p, case when abs(x) > abs(y) then x else y end pmax, round(coalesce(abs(x - y) / nullif(x + y, 0), 0), 6) pref,
round(1 / (1 + exp(-0.1 * (x - 25))), 6) logi, round(3 / (1 + exp(-0.1 * (x - 25))) + 1, 6) sig, round(0.5 + 1.5 / (1 + exp(-0.2 * (x - 20))), 6) imp1,
round((0.5 + 1.5 / (1 + exp(-0.2 * (x - 20)))) * (1 + 1 / (1 + exp(0.3 * (x - 35)))) / 2, 6) imp2, ceil(y) = floor(y) whole from m""")
def scalar_math(spark, sf_dir):
    line = fx.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("p"))
    r = lambda c: F.round(c, 6)
    return line.withColumns({"pmax": X.pmax_abs("x", "y"), "pref": r(X.preference("x", "y")), "logi": r(X.logistic("x", 25.0, 0.1)), "sig": r(X.sigmoid("x", 0.1, 25.0, 3.0, 1.0)), "imp1": r(X.impulse_single("x", -0.2, 0.5, 2.0, 20.0)), "imp2": r(X.impulse_double("x", -0.2, 0.3, 0.5, 2.0, 1.0, 20.0, 35.0)), "whole": X.is_whole("y")})


@query(f"""with m as ({MATH}) select p, round(avg(x) filter (x > 0), 6) mp, round(log2(avg(power(2, y / 20) - 1) + 1), 6) ml, round(log2(sum(power(2, y / 20) - 1) + 1), 6) sl, round(count(*) filter (x > 25) / count(*), 6) pe,
case when count(distinct l_linenumber) = 1 then max(l_linenumber) end ou from m group by 1""")
def aggregate_math(spark, sf_dir):
    line = fx.load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000 / 20).alias("y"), F.col("l_discount").alias("p"))
    return line.groupBy("p").agg(F.round(X.mean_pos("x"), 6).alias("mp"), F.round(X.mean_of_logs("y"), 6).alias("ml"), F.round(X.sum_of_logs("y"), 6).alias("sl"), F.round(X.prop_exp("x", 25.0), 6).alias("pe"), X.output_uniform("l_linenumber").alias("ou"))


def _window_means(spark, sf_dir):
    e = fx.clamped(spark, sf_dir)
    pt = fx.vectors(spark, sf_dir).select("cell", F.get("vec", 0).alias("pseudotime"))
    w = tree.moving_windows(tree.near_equal(pt, [], ["pseudotime", "cell"], 40, scratch=_scratch(spark, "order")), 3)
    return curves.window_means(e, w)


@query()
def smoothed_expression(spark, sf_dir):
    return curves.smooth(_window_means(spark, sf_dir))


@query()
def spline_expression(spark, sf_dir):
    return curves.smooth(_window_means(spark, sf_dir), method="spline")


@query()
def fit_points(spark, sf_dir):
    means = _window_means(spark, sf_dir)
    return views.fit_points({"lowess": curves.smooth(means), "spline": curves.smooth(means, method="spline")}, ["1", "5"], scaled=True)


@query()
def impulse_cascade(spark, sf_dir):
    return curves.cascade(_window_means(spark, sf_dir), starts=3)


@query()
def segment_divergence(spark, sf_dir):
    v = _visits(spark, sf_dir)
    pairs = spark.createDataFrame([("s0", "s1"), ("s0", "s2"), ("s1", "s2")], "s1 string, s2 string")
    return tree.divergence(v, _pt(spark, sf_dir).select("cell", "pseudotime"), pairs, threshold=0.2, cuts=10, width=3)


@query(f"""with {VISITS}, {PT.replace(SQL['w1'] + ', ', '')}, t as (select *, max(v) over (partition by cell) top from vs), sg as (select cell, segment from t where top >= 10 and v >= 0.2 * top), pr as (select * from (values ('s0', 's1'), ('s0', 's2'), ('s1', 's2')) t(s1, s2)),
ip as (select s1, s2, cell from pr join sg on segment = s1 union select s1, s2, cell from pr join sg on segment = s2), vv as (select s1, s2, ip.cell, a.v v1, b.v v2, pt from ip join vs a on a.segment = s1 and a.cell = ip.cell join vs b on b.segment = s2 and b.cell = ip.cell join pt on pt.cell = ip.cell),
nq as (select *, row_number() over (partition by s1, s2 order by pt, cell) r, count(*) over (partition by s1, s2) m from vv), nw as (select *, greatest(round_even(m / 10, 0), 1) n from nq), gw as (select *, (select count(*) from range(1, n::int + 1) x(g) where round_even(m / n * g, 0) < r) + 1 grp from nw), tw as (select s1, s2, max(grp) top from gw group by 1, 2),
wi as (select s1, s2, s as win, list(v1) a, list(v2) b, count(*) n, avg(pt) mean_pt, min(pt) min_pt, max(pt) max_pt from gw join tw using (s1, s2), range(1, 1000) q(s) where s <= top - 2 and grp between s and s + 2 group by 1, 2, 3),
ks as (select *, list_max(list_transform(list_concat(a, b), lambda x: abs(len(list_filter(a, lambda y: y <= x)) / n - len(list_filter(b, lambda y: y <= x)) / n))) * sqrt(n / 2) z from wi),
pp as (select *, case when z < 0.2 then 1 else least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: power(-1, k - 1) * exp(-2 * k * k * z * z))))) end p from ks), ho as (select *, row_number() over (partition by s1, s2 order by p) r, count(*) over (partition by s1, s2) m from pp), hp2 as (select *, least(1, max(p * (m - r + 1)) over (partition by s1, s2 order by r)) h from ho)
select s1, s2, win::int as window, round(p, 7) p, round(max(h) over (partition by s1, s2, p), 7) p_adj, round(mean_pt, 6) mean_pt, round(min_pt, 6) min_pt, round(max_pt, 6) max_pt, n from hp2""")
def window_divergence(spark, sf_dir):
    pairs = spark.createDataFrame([("s0", "s1"), ("s0", "s2"), ("s1", "s2")], "s1 string, s2 string")
    out = tree.divergence(_visits(spark, sf_dir), _pt(spark, sf_dir).select("cell", "pseudotime"), pairs, threshold=0.2, cuts=10, width=3)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("s1", "s2", "window", _r("p", 7).alias("p"), _r("p_adj", 7).alias("p_adj"), *[_r(c).alias(c) for c in ("mean_pt", "min_pt", "max_pt")], n.alias("n"))


# expressions and small operators ------------------------------------------------------------------


def _r(c, n: int = 6):
    return F.round(c, n)


#: Published derivatives of the logistic s: k * s * (1 - s), and k^2 * s * (1 - s) * (1 - 2 * s); products by Leibniz' rule.
PARTS = f"select l_orderkey, l_linenumber, x, 0.5 + 1.5 * s1 f1, 1.5 * 0.2 * s1 * (1 - s1) d1, 1.5 * 0.04 * s1 * (1 - s1) * (1 - 2 * s1) e1, 1 + s2 f2, -0.3 * s2 * (1 - s2) d2, 0.09 * s2 * (1 - s2) * (1 - 2 * s2) e2 from (select l_orderkey, l_linenumber, l_quantity x, 1 / (1 + exp(-0.2 * (l_quantity - 20))) s1, 1 / (1 + exp(0.3 * (l_quantity - 35))) s2 from lineitem)"


@query(f"""with m as ({PARTS}) select l_orderkey, l_linenumber, round(d1, 6) slope1, round(e1, 6) bend1, round((d1 * f2 + f1 * d2) / 2, 6) slope2, round((e1 * f2 + 2 * d1 * d2 + f1 * e2) / 2, 6) bend2 from m""")
def impulse_derivatives(spark, sf_dir):
    line = fx.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))
    one, two = ("x", -0.2, 0.5, 2.0, 20.0), ("x", -0.2, 0.3, 0.5, 2.0, 1.0, 20.0, 35.0)
    return line.select("l_orderkey", "l_linenumber", _r(X.impulse_slope_single(*one)).alias("slope1"), _r(X.impulse_bend_single(*one)).alias("bend1"), _r(X.impulse_slope_double(*two)).alias("slope2"), _r(X.impulse_bend_double(*two)).alias("bend2"))


@query("""select l_orderkey, l_linenumber, round(25 - ln(1 / p - 1) / 0.1, 6) inv_logi, round(25 - ln(3 / p - 1) / 0.1, 6) inv_sig, round(0.3 * exp(-0.1 * (x - 25)) / power(1 + exp(-0.1 * (x - 25)), 2), 6) slope
from (select l_orderkey, l_linenumber, l_quantity x, (l_discount + 0.01) * 5 p from lineitem)""")
def inverse_curves(spark, sf_dir):
    line = fx.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), ((F.col("l_discount") + 0.01) * 5).alias("p"), ((F.col("l_discount") + 0.01) * 5 + 1).alias("y"))
    return line.select("l_orderkey", "l_linenumber", _r(X.inv_logistic("p", 25.0, 0.1)).alias("inv_logi"), _r(X.inv_sigmoid("y", 0.1, 25.0, 3.0, 1.0)).alias("inv_sig"), _r(X.d_dx_sigmoid("x", 0.1, 25.0, 3.0)).alias("slope"))


@query("""with v as (select label::varchar grp, unnest(embedding)::double x from embeddings) select grp, round(log2(avg(power(2, x) - 1) filter (x > 0) + 1), 6) ml_pos, round(count(*) filter (x <= 0) / count(*), 6) nonexp, round(1 - exp(sum(ln(1 - abs(x) / 1000))), 6) any_of from v group by 1""")
def more_aggregates(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("grp", F.explode("vec").alias("x")).withColumn("p", F.abs("x") / 1000)
    return v.groupBy("grp").agg(_r(X.mean_of_logs_pos("x")).alias("ml_pos"), _r(X.prop_nonexp("x")).alias("nonexp"), _r(X.combine_probs("p")).alias("any_of"))


@query("select o_orderpriority g, round(avg(try_cast(split_part(o_orderpriority, '-', 1) as double)), 6) num, split_part(o_orderpriority, '-', 2) part from orders group by 1")
def text_numbers(spark, sf_dir):
    o = fx.load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), X.cut_string("o_orderpriority", "-", 1).alias("x"))
    return o.groupBy("g").agg(_r(X.num_mean("x")).alias("num")).withColumn("part", X.cut_string("g", "-", 2))


@query(f"with {SQL['m1']} select cell, gene, least(count, 1)::double as count from m1")
def binary_counts(spark, sf_dir):
    return expression.binary(fx.supplier_counts(spark, sf_dir)).withColumn("count", F.col("count").cast("double"))


@query(f"with {SQL['e1']} select cell, gene, round(power(2, value) - 1, 6) as value from c1")
def unlogged_values(spark, sf_dir):
    return expression.unlogged(fx.clamped(spark, sf_dir)).select("cell", "gene", F.round("value", 6).alias("value"))


@query(f"with {SQL['e1']} select cell, round(log2(sum(power(2, value) - 1) + 1), 6) score from c1 where gene in ('1', '5', '9') group by 1")
def signature_score(spark, sf_dir):
    return expression.signature_score(fx.clamped(spark, sf_dir), ["1", "5", "9"]).withColumn("score", F.round("score", 6))


@query("select c_custkey cell from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def cells_in_cluster(spark, sf_dir):
    groups = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"))
    return expression.cells_in_cluster(groups, ["BUILDING", "MACHINERY"])


@query("select c_custkey cell, 'wealth' grouping, case when c_acctbal > 5000 then 'rich' when c_acctbal < 4000 then 'poor' end as value from customer where c_acctbal > 5000 or c_acctbal < 4000")
def group_from_cells(spark, sf_dir):
    c = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), "c_acctbal")
    return expression.group_from_cells(c, "wealth", {"poor": c.where("c_acctbal < 4000"), "rich": c.where("c_acctbal > 5000")})


@query(f"with {SQL['m2']} select cell, gene, count::double as count from m2 where gene in (select distinct gene from m2 order by 1 limit 5) and cell in (select distinct cell from m2 order by 1 limit 5)")
def corner_of_counts(spark, sf_dir):
    return expression.corner(fx.customer_counts(spark, sf_dir)).select("cell", "gene", F.col("count").cast("double").alias("count"))


@query(f"with {SQL['m1']} select cell, gene, count::double as count from m1 where cell in (select s_suppkey::varchar from supplier where s_acctbal between 0 and 6000) and count <> 0")
def metadata_trim(spark, sf_dir):
    meta = fx.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cell"), "s_acctbal")
    return ingest.meta_trim(fx.supplier_counts(spark, sf_dir), meta, "s_acctbal", 0.0, 6000.0).select("cell", "gene", F.col("count").cast("double").alias("count"))


@query("""select l_suppkey barcode, sum(l_partkey) reads, sum(l_linenumber) unmapped_reads, sum(l_orderkey % 5) nonconf_mapped_reads, sum(l_partkey + l_linenumber + l_orderkey % 5) total_reads,
list_aggregate(list_transform(range(15, -1, -1), lambda k: substr('ACGT', (l_suppkey >> (2 * k)::int & 3)::int + 1, 1)), 'string_agg', '') cell from lineitem group by l_suppkey""")
def reads_per_cell(spark, sf_dir):
    m = fx.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("barcode"), F.col("l_partkey").alias("reads"), F.col("l_linenumber").alias("unmapped_reads"), (F.col("l_orderkey") % 5).alias("nonconf_mapped_reads"))
    return ingest.reads_per_cell(m)


@query(f"with {SQL['m2']} select cell, gene, count::double as count from m2 where cell in (select c_custkey::varchar from customer where c_nationkey < 5) and count <> 0")
def container_subset(spark, sf_dir):
    c = ingest.create(fx.customer_counts(spark, sf_dir), min_cells=0, min_genes=0, min_counts=0, gene_max_cut=1e18)
    keep = fx.load(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("cell"))
    return ingest.subset(c, keep).counts.select("cell", "gene", F.col("count").cast("double").alias("count"))


# more of the graph ------------------------------------------------------------------------------


DIFF = f"""{KNN}, nb as (select * from kn where rank <= 10), lo as (select cell, avg(dist) s from nb where rank between 5 and 7 group by 1), ke as (select nb.cell i, nbr j, exp(-dist * dist / (2 * a.s * b.s)) w from nb join lo a on a.cell = nb.cell join lo b on b.cell = nbr),
sy as (select i, j, max(w) w from (select * from ke union all select j, i, w from ke) group by 1, 2), d1 as (select i, sum(w) d from sy group by 1), s1 as (select sy.i, sy.j, w / (a.d * b.d) w from sy join d1 a on a.i = sy.i join d1 b on b.i = sy.j),
d2 as (select i, sum(w) d from s1 group by 1), df as (select s1.i, s1.j, w / sqrt(a.d * b.d) w from s1 join d2 a on a.i = s1.i join d2 b on b.i = s1.j)"""


def _diffusion(spark, sf_dir):
    return neighbors.diffusion_edges(_knn(spark, sf_dir, 10))


@query(f"with {DIFF} select i, j, round(w, 6) w from df")
def diffusion_edges(spark, sf_dir):
    return _diffusion(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(f"with {DIFF} select least(i, j) a, greatest(i, j) b, round(max(w), 6) w from df where i <> j and (i % 7 = 3 or j % 7 = 3) group by 1, 2")
def edges_of_cells(spark, sf_dir):
    e = _diffusion(spark, sf_dir)
    return neighbors.undirected_edges(e, fx.vectors(spark, sf_dir).where("cell % 7 = 3"), connected=True).withColumn("w", F.round("w", 6))


@query(f"""with {KNN}, nb as (select * from kn where rank <= 15), r as (select log10(min(dist) filter (dist > 0)) lo, log10(max(dist)) hi from nb), w as (select s step, lo + (hi - lo) * s / 24 e from r, range(25) t(s)),
ks as (select step, any_value(e) e, cell, log10(1 + sum(exp(-dist * dist / (2 * power(10, e) * power(10, e))))) l from nb, w group by step, cell), m as (select step, any_value(e) e, avg(l) m from ks group by 1), d as (select step, e, m, (lead(m) over (order by step) - m) / ((select (hi - lo) / 24 from r)) slope from m)
select step::int step, round(power(10, e), 6) sigma, round(m, 6) mean_log, round(slope, 5) slope, step = (select arg_max(step, slope) from d) chosen from d""")
def kernel_sweep(spark, sf_dir):
    out = neighbors.kernel_sweep(_knn(spark, sf_dir, 15))
    return out.withColumns({"sigma": F.round("sigma", 6), "mean_log": F.round("mean_log", 6), "slope": F.round("slope", 5)})


@query()
def diffusion_components(spark, sf_dir):
    scratch = _scratch(spark, "diffusion")
    return neighbors.diffusion_components(scratch.table(_diffusion(spark, sf_dir), "edges"), 6, scratch)[1]


@query(f"""with {DIFF}, g as (select vec_id cell, label::varchar grp, embedding[1]::double pt from embeddings), me as (select grp, avg(pt) m from g group by 1), ne as (select a.grp, j cell, 1 - exp(sum(ln(1 - w))) p from df join g a on a.cell = i join g b on b.cell = j where a.grp <> b.grp group by 1, 2)
select ne.grp, round(sum(p) filter (g.pt < m) / sum(p), 6) tip_potential from ne join g using (cell) join me on me.grp = ne.grp group by 1""")
def cluster_tip_potential(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    out = pseudotime.cluster_tip_potential(_diffusion(spark, sf_dir), v.select("cell", "grp"), v.select("cell", F.get("vec", 0).alias("pseudotime")))
    return out.withColumn("tip_potential", F.round("tip_potential", 6))


@query("with v as (select vec_id, embedding::double[] e from embeddings), d as (select a.vec_id cell, list_distance(a.e, b.e) d, a.e[1] pa, b.e[1] pb from v a join v b on a.vec_id <> b.vec_id) select cell, round(avg((pb <= pa)::int), 6) tip_potential from d where d between 1.2 and 1.4 group by 1")
def tip_potential(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    out = pseudotime.tip_potential(v.select("cell", "vec"), v.select("cell", F.get("vec", 0).alias("pseudotime")), 1.2, 1.4, _scratch(spark, "potential"))
    return out.withColumn("tip_potential", F.round("tip_potential", 6))


# more of the tree --------------------------------------------------------------------------------


@query(f"""with {VISITS}, t as (select cell, case when segment in ('s0', 's1') then 'new' else segment end tip, sum(v * n) / any_value(tot) v from (select vs.*, case segment when 's0' then 3 when 's1' then 1 else 2 end n, case when segment in ('s0', 's1') then 4 else 2 end tot from vs) group by 1, 2) select tip, cell, round(v, 6) v from t""")
def combined_tips(spark, sf_dir):
    cells = spark.createDataFrame([("s0", "a"), ("s0", "b"), ("s0", "c"), ("s1", "d"), ("s2", "e"), ("s2", "f")], "tip string, cell string")
    return tree.combine_tips(_visits(spark, sf_dir).withColumnRenamed("segment", "tip"), cells, "s0", "s1", "new")[0].withColumn("v", F.round("v", 6))


NODES = f"""{PT}, sg as (select cell, split_part(cell, '-', 1) segment, pt from pt), nn as (select *, row_number() over (partition by segment order by pt, cell) r, count(*) over (partition by segment) m from sg), nk as (select *, greatest(round_even(m / 5, 0), 1) n from nn),
ng as (select cell, segment, pt, (select count(*) from range(1, n::int + 1) x(g) where round_even(m / n * g, 0) < r) + 1 k from nk), nd as (select segment, k, segment || '-' || k node, avg(pt) mean_pt, max(pt) max_pt, count(*) n from ng group by 1, 2)"""


def _nodes(spark, sf_dir):
    pt = _pt(spark, sf_dir)
    return tree.nodes(pt.select("cell", X.cut_string("cell", "-", 1).alias("segment")), pt.select("cell", "pseudotime"), 5)


@query(f"with {NODES} select node, segment, k::int k, round(mean_pt, 6) mean_pt, round(max_pt, 6) max_pt, n from nd")
def tree_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)[1].select("node", "segment", "k", _r("mean_pt").alias("mean_pt"), _r("max_pt").alias("max_pt"), "n")


@query(f"""with {NODES}, jn as (select * from (values ('view', 'click'), ('view', 'purchase'), ('click', 'cart')) t(parent, child)), la as (select segment, arg_max(node, k) a from nd group by 1)
select node a, b from (select node, lead(node) over (partition by segment order by k) b from nd) where b is not null union all select a, node b from jn join la on la.segment = parent join nd on nd.segment = child and k = 1""")
def tree_node_edges(spark, sf_dir):
    joins = spark.createDataFrame([("view", "click"), ("view", "purchase"), ("click", "cart")], "parent string, child string")
    return tree.node_edges(_nodes(spark, sf_dir)[1], joins)


@query(f"""with {PT}, vs as (select 's' || (walk % 3) segment, cell, count(*) v from w1 group by 1, 2), li as (select * from (values ('s0', 0.0, 0.5), ('s1', 0.45, 1.0), ('s2', 0.0, 1.0)) t(segment, lo, hi)),
a as (select vs.cell, segment, case when pt between lo and hi then v else 0 end v from vs join pt using (cell) join li using (segment)) select cell, max(v) visits from a group by 1 having max(v) > 0""")
def cells_of_segments(spark, sf_dir):
    limits = spark.createDataFrame([("s0", 0.0, 0.5), ("s1", 0.45, 1.0), ("s2", 0.0, 1.0)], 'segment string, start double, `end` double')
    v, pt = _visits(spark, sf_dir), _pt(spark, sf_dir).select("cell", "pseudotime")
    return tree.assign_cells(v, pt, limits).join(v, ["segment", "cell"]).select("cell", F.col("v").alias("visits"))


@query(f"""with {PT}, vs as (select 's' || (walk % 3) segment, cell, count(*) v from w1 group by 1, 2), li as (select * from (values ('s0', 0.0, 0.5), ('s1', 0.45, 1.0), ('s2', 0.0, 1.0)) t(segment, lo, hi)),
a as (select vs.cell, segment, case when pt between lo and hi then v else 0 end v from vs join pt using (cell) join li using (segment)) select cell, any_value(segment) segment from (select *, max(v) over (partition by cell) top from a) where v = top and top > 0 group by 1 having count(*) = 1""")
def assigned_segments(spark, sf_dir):
    limits = spark.createDataFrame([("s0", 0.0, 0.5), ("s1", 0.45, 1.0), ("s2", 0.0, 1.0)], 'segment string, start double, `end` double')
    v, pt = _visits(spark, sf_dir), _pt(spark, sf_dir).select("cell", "pseudotime")
    chosen = tree.assign_cells(v, pt, limits)
    # ties are broken by a hash, which SQL does not know: cells that have one are left out of this comparison
    held = v.join(pt, "cell").join(limits, "segment").withColumn("v", F.when(F.col("pseudotime").between(F.col("start"), F.col("end")), F.col("v")).otherwise(0))
    best = held.groupBy("cell").agg(F.max("v").alias("v")).join(held, ["cell", "v"]).groupBy("cell").agg(F.count("*").alias("k")).where("k = 1")
    return chosen.join(best, "cell", "left_semi")


@query("with j as (select n_regionkey parent, min(n_nationkey) c1, max(n_nationkey) c2, n_regionkey / 10.0 pt from nation group by 1) select parent, c1 child, pt pseudotime from j union all select parent, c2, pt from j")
def interleaved_joins(spark, sf_dir):
    j = fx.load(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.min("n_nationkey").alias("child_1"), F.max("n_nationkey").alias("child_2")).withColumn("pseudotime", F.col("parent") / 10.0)
    return tree.interleaved(j)


def _deep(spark, sf_dir):
    rows = [(r["parent"], r["child"], {"w": 0.0, "r": 1.0, "n": 2.0}[r["parent"][0]]) for r in fx.tree(spark, sf_dir).collect()]
    limits = {c: (pt, pt + 1.0) for _, c, pt in rows} | {"world": (-1.0, 0.0)}
    return rows, limits


@query(f"with {SQL['t1']}, u as (select parent from t1 group by 1 having count(*) = 1) select parent, child from t1 where parent not in (select parent from u)")
def without_only_children(spark, sf_dir):
    return spark.createDataFrame([j[:2] for j in tree.remove_unary(*_deep(spark, sf_dir))[0]], "parent string, child string")


@query(f"""with {SQL['t1']}, go as (select 'n' || n_nationkey s from nation where n_nationkey % 6 = 1), d as (select parent, child, case substr(parent, 1, 1) when 'w' then 0.0 when 'r' then 1.0 else 2.0 end pt from t1),
k as (select case when g.s is not null then up.parent else d.parent end parent, d.child, d.pt, g.s from d left join go g on g.s = d.parent left join d up on up.child = g.s where d.child not in (select s from go)),
mx as (select parent, max(pt) pt from k group by 1) select k.parent, k.child, case when k.parent in (select parent from k where s is not null) then mx.pt else k.pt end::double pseudotime from k join mx on mx.parent = k.parent""")
def collapsed_segments(spark, sf_dir):
    rows, limits = _deep(spark, sf_dir)
    cells = {c: 0 if c[0] == "n" and int(c[1:]) % 6 == 1 else 9 for c in limits}
    return spark.createDataFrame(tree.collapse_short(rows, limits, cells, "world")[0], "parent string, child string, pseudotime double")


# tests along the tree ------------------------------------------------------------------------------

CHAIN = f"""{UP}, cs as (select c_custkey::varchar cell, case when c_custkey % 4 = 0 then 'r' || n_regionkey else 'n' || n_nationkey end segment, c_acctbal / 10000 pt from customer join nation on n_nationkey = c_nationkey),
pa as (select 'n3' segment, 0 depth union all select ancestor, depth from up where segment = 'n3'), pr as (select pa.segment, pa.depth, b.child opposing from pa join t1 a on a.child = pa.segment join t1 b on b.parent = a.parent and b.child <> a.child),
be as (select ancestor opposing, segment as at from up union select child, child from t1),
co as (select depth, pr.segment, opposing, cell, 1 side from pr join cs on cs.segment = pr.segment union select depth, pr.segment, pr.opposing, cell, 2 from pr join be on be.opposing = pr.opposing join cs on cs.segment = be.at where pt between 0.1 and 0.8)"""


def _compared(spark, sf_dir):
    c = fx.load(spark, sf_dir, "customer").join(fx.load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    at = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    cells = c.select(F.col("c_custkey").cast("string").alias("cell"), at.alias("segment"), (F.col("c_acctbal") / 10000).alias("pseudotime"))
    joins = fx.tree(spark, sf_dir)
    limits = joins.select(F.col("child").alias("segment"), F.lit(0.1).alias("start"), F.lit(0.8).alias("end"))
    return along_tree.comparisons(joins, limits, cells.select("cell", "segment"), cells.select("cell", "pseudotime"), "n3")


@query(f"with recursive {CHAIN} select * from co")
def comparisons_along_tree(spark, sf_dir):
    return _compared(spark, sf_dir)


def _auc_sql(x: str, sd: str, least_frac: float, bound: str, genes: str = "true") -> str:
    """CTEs ending in ``au{x}``: markers by precision and recall over (cmp, cell, side) of ``sd``."""
    return f"""z{x} as (select cmp, count(*) filter (side = 1) n1, count(*) filter (side = 2) n2 from {sd} group by 1), mt{x} as (select gene, cell, value, cmp, side from ex join {sd} using (cell) where {genes}),
u{x} as (select cmp, gene, n1, n2, coalesce(sum(power(2, value) - 1) filter (side = 1), 0) u1, coalesce(sum(power(2, value) - 1) filter (side = 2), 0) u2, count(*) filter (side = 1 and value > 0) k1, count(*) filter (side = 2 and value > 0) k2 from mt{x} join z{x} using (cmp) group by all),
g{x} as (select cmp, gene, n1, n2, round(k1 / n1, 3) frac_1, round(k2 / n2, 3) frac_2, round(log2(u1 / n1 + 1), 3) exp_1, round(log2(u2 / n2 + 1), 3) exp_2 from u{x} where n1 > 0 and n2 > 0),
f{x} as (select *, case when exp_2 = 0 and exp_1 > 0 then 'infinity'::double when exp_1 > 0 then log2((power(2, exp_1) - 1) / (power(2, exp_2) - 1)) end exp_fc from g{x}),
p{x} as (select * from f{x} where greatest(frac_1, frac_2) > {least_frac} and abs(frac_1 - frac_2) > 0 and exp_fc > 0),
r{x} as (select cmp, gene, value, count(*) filter (side = 1) p, count(*) filter (side = 2) n from mt{x} semi join p{x} using (cmp, gene) where value <> 0 group by 1, 2, 3),
al{x} as (select * from r{x} union all select cmp, gene, 0, n1 - coalesce(sp, 0), n2 - coalesce(sn, 0) from p{x} left join (select cmp, gene, sum(p) sp, sum(n) sn from r{x} group by 1, 2) using (cmp, gene) where n1 - coalesce(sp, 0) + n2 - coalesce(sn, 0) > 0),
c{x} as (select cmp, gene, value, sum(p) over w / sum(p) over (partition by cmp, gene) rec, sum(p) over w / (sum(p) over w + sum(n) over w) prec from al{x} window w as (partition by cmp, gene order by value desc)),
st{x} as (select cmp, gene, (rec - lag(rec) over w) * (prec + lag(prec) over w) / 2 s from c{x} window w as (partition by cmp, gene order by value desc)),
au{x} as materialized (select cmp, gene, n1, n2, frac_1, frac_2, exp_1, exp_2, exp_fc, auc, auc / (n1 / (n1 + n2)) ratio from p{x} join (select cmp, gene, round(coalesce(sum(s), 0), 3) auc from st{x} group by 1, 2) using (cmp, gene) where auc >= {bound})"""


BEYOND = "least(n1 / (n1 + n2), 1)"
#: What no segment farther down has against it and half of the siblings at least are beaten in, from (cmp, gene) of ``found`` and ``against``.
KEPT = """nm as (select distinct cmp, segment, depth from cd), lo as (select gene, min(depth) low from {against} join nm using (cmp) group by 1),
k0 as (select f.*, segment, depth from {found} f join nm using (cmp) left join lo using (gene) where low is null or low >= depth), sb as (select segment, count(*) siblings from nm group by 1),
kt as materialized (select * exclude (siblings) from (select k0.*, siblings, count(*) over (partition by segment, gene) beaten from k0 join sb using (segment)) where beaten >= siblings * 0.5)"""
BEST = "be2 as (select gene, max({{'v': {by}, 'd': -depth, 'c': cmp}}) x, min({{'v': {by}, 'd': depth, 'c': cmp}}) n from kt group by 1)"
NAMED = f"{CHAIN}, {CREATED}, cd as materialized (select segment || '-' || opposing cmp, segment, depth, cell, side from co)"


@query(f"""with recursive {NAMED}, s1 as (select '+' || cmp cmp, cell, side from cd union all select '-' || cmp, cell, 3 - side from cd), {_auc_sql('1', 's1', 0.1, BEYOND)},
plus as (select substr(cmp, 2) cmp, gene, ratio from au1 where cmp like '+%'), minus as (select substr(cmp, 2) cmp, gene from au1 where cmp like '-%'), {KEPT.format(found='plus', against='minus')},
s2 as (select 'all' cmp, cell, side from cd), {_auc_sql('2', 's2', 0, BEYOND, 'gene in (select gene from kt)')}, {BEST.format(by='ratio')}
select gene, frac_1, frac_2, exp_1, exp_2, round(exp_fc, 6) exp_fc, auc, round(ratio, 9) ratio, x.c segment_max, round(x.v, 9) ratio_max, n.c segment_min, round(n.v, 9) ratio_min from au2 join be2 using (gene)""")
def aucpr_along_tree(spark, sf_dir):
    out = along_tree.auc_pr(_created(spark, sf_dir).expr, _compared(spark, sf_dir), _scratch(spark, "along"), effect=0.0, min_diff=0.0)
    return out.withColumns({"exp_fc": F.round("exp_fc", 6)} | {c: F.round(c, 9) for c in ("ratio", "ratio_max", "ratio_min")})


@query(f"""with recursive {NAMED}, {_binom_sql('cd', 'greatest(frac_1, frac_2) >= 0.1', x='1')}, {KEPT.format(found='bi1', against='(select * from bi1 where log_effect < 0)')},
s2 as (select 'all' cmp, cell, side from cd), {_binom_sql('s2', 'greatest(frac_1, frac_2) >= 0', '(select distinct gene from kt)', '2')}, {BEST.format(by='log_effect')}
select gene, round(p_adj, 8) p_adj, round(log_effect, 6) log_effect, frac_1, frac_2, trans_1, trans_2, x.c segment_max, round(x.v, 6) log_effect_max, n.c segment_min, round(n.v, 6) log_effect_min from bi2 join be2 using (gene)""")
def binom_along_tree(spark, sf_dir):
    c = _created(spark, sf_dir)
    out = along_tree.binom(c.expr, c.counts, _compared(spark, sf_dir), _scratch(spark, "along"), effect=0.0, p_max=1.0)
    return out.withColumns({"p_adj": F.round("p_adj", 8)} | {c: F.round(c, 6) for c in ("log_effect", "log_effect_max", "log_effect_min")})


@query(f"""with recursive {NAMED}, sd as (select cmp, cell, side from cd semi join tot using (cell)), {WELCH}, nm as (select distinct cmp, segment from cd semi join tot using (cell)), sb as (select segment, count(*) n from nm group by 1),
up2 as (select name from (select segment, name, count(*) k from wl join nm using (cmp) where log_fc > 0 and m1 >= 0.1 group by 1, 2) join sb using (segment) where k = n)
select distinct name, 'up' state from up2 union all select distinct name, 'down' from wl where log_fc < 0 and m2 >= 0.1""")
def modules_along_tree(spark, sf_dir):
    c = _created(spark, sf_dir)
    values = c.expr.select(F.col("gene").alias("name"), "cell", F.col("value").alias("v"))
    return along_tree.modules(values, c.cells, _compared(spark, sf_dir), _scratch(spark, "along"), effect=0.0, p_max=1.0)


@query(f"""with {CREATED}, se as (select c_custkey::varchar cell, case when c_nationkey < 8 then 'one' when c_nationkey < 16 then 'two' else 'three' end s, c_mktsegment grp from customer), ot as (select distinct s other from se where s <> 'one'),
sd as (select grp || '|' || other cmp, grp, cell, 1 side from se, ot where s = 'one' union all select grp || '|' || s, grp, cell, 2 from se where s <> 'one'), {_auc_sql('1', 'sd', 0.1, BEYOND.replace(', 1)', ", 'inf'::double)"))},
pa as (select gene, split_part(cmp, '|', 1) grp from au1 where exp_fc > 0 and auc >= greatest(0.1, n1 / (n1 + n2))), en as (select gene, count(*) groups_marked from (select gene, grp from pa group by 1, 2 having count(*) = (select count(*) from ot)) group by 1),
be as (select gene, max({{'auc': auc, 'cmp': cmp}}) b from au1 group by 1)
select gene, groups_marked, cmp comparison_best, auc auc_best, round(exp_fc, 6) exp_fc_best, frac_1, frac_2, exp_1, exp_2 from en join be using (gene) join au1 using (gene) where cmp = b.cmp""")
def aucpr_by_factor(spark, sf_dir):
    groups = _segments(spark, sf_dir)
    sets = fx.load(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 8, "one").when(F.col("c_nationkey") < 16, "two").otherwise("three").alias("name"), F.col("c_custkey").cast("string").alias("cell"))
    return along_tree.auc_pr_by_factor(_created(spark, sf_dir).expr, sets, groups, _scratch(spark, "factor"), effect=0.0).withColumn("exp_fc_best", F.round("exp_fc_best", 6))


# coordinates ---------------------------------------------------------------------------------------

XYZ = "p as (select vec_id cell, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, label from embeddings)"


def _points(spark, sf_dir):
    return fx.vectors(spark, sf_dir).select("cell", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"), F.get("vec", 2).alias("z"), "grp")


@query(f"with {XYZ} select cell, round(x * cos(0.5) - z * sin(0.5), 6) x, round(y, 6) y, round(x * sin(0.5) + z * cos(0.5), 6) z from p")
def rotated_points(spark, sf_dir):
    x, y, z = curves.rotate("x", "y", "z", 0.5, "y")
    return _points(spark, sf_dir).select("cell", _r(x).alias("x"), _r(y).alias("y"), _r(z).alias("z"))


@query(f"""with recursive {UP}, {XYZ}, sg as (select cell, x, y, z, 'n' || (cell % 25) s from p), ch as (select cell, x, y, z, row_number() over (order by x, cell) r from sg where s in (select segment from up where ancestor = 'r1')), ce as (select x cx, y cy, z cz from ch where r = 5)
select p.cell, round(case when ch.r > 3 then cx + (p.x - cx) * cos(0.5) - (p.z - cz) * sin(0.5) else p.x end, 6) x, round(p.y, 6) y, round(case when ch.r > 3 then cz + (p.x - cx) * sin(0.5) + (p.z - cz) * cos(0.5) else p.z end, 6) z from p left join ch using (cell), ce""")
def rotated_subtree(spark, sf_dir):
    p = _points(spark, sf_dir).select("cell", "x", "y", "z")
    segment = p.select("cell", F.concat(F.lit("n"), (F.col("cell") % 25).cast("string")).alias("segment"))
    below = curves.subtree_cells(fx.tree(spark, sf_dir), segment, "r1")
    out = curves.rotate_cells(p, 0.5, "y", below, around=2, pt=p.select("cell", F.col("x").alias("pseudotime")), spare=3)
    return out.select("cell", *[_r(c).alias(c) for c in "xyz"])


@query(f"with {XYZ} select cell, round(case when label = 1 then x + 0.5 else x end, 6) x, round(y, 6) y, round(case when label = 1 then z - 2 else z end, 6) z from p")
def translated_points(spark, sf_dir):
    return curves.translate(_points(spark, sf_dir), F.col("grp") == "1", dx=0.5, dz=-2.0).select("cell", *[_r(c).alias(c) for c in "xyz"])


@query(f"""with {XYZ}, l as (select max(z) z0 from (select z from p where label = 2 order by z limit 20))
select cell, round(case when label = 2 and z > z0 then z0 + (z - z0) * (1 + 2 * least((z - z0) / 0.1, 1)) else z end, 6) z from p, l""")
def stretched_points(spark, sf_dir):
    return curves.stretch(_points(spark, sf_dir), F.col("grp") == "2", 3.0).select("cell", _r("z").alias("z"))


@query(f"with {XYZ} select cell, round(x * 0.2 + y * 0.3 + z * 0.5, 6) m from p")
def interpolated_points(spark, sf_dir):
    return _points(spark, sf_dir).select("cell", _r(curves.interpolate_points({"x": 0.2, "y": 0.3, "z": 0.5})).alias("m"))


@query(f"""with {PT}, vs as (select 's' || (walk % 4) segment, cell, count(*) v from w1 group by 1, 2), g as (select cell, coalesce(max(v) filter (segment = 's0'), 0) a, coalesce(max(v) filter (segment = 's1'), 0) b, coalesce(max(v) filter (segment in ('s0', 's1', 's2')), 0) p, coalesce(max(v) filter (segment = 's3'), 0) o from vs group by 1),
q as (select cell, coalesce((a - b) / nullif(a + b, 0), 0) pref, coalesce((p - o) / nullif(p + o, 0), 0) par, log10(a + b + 1) vis from g) select cell, round(pref, 6) preference, round(par, 6) parent_preference, round(vis, 6) visited, round(pt, 6) pseudotime from q join pt using (cell) where par >= 0.1""")
def branch_preference(spark, sf_dir):
    v = fx.walks(spark, sf_dir).groupBy(F.concat(F.lit("s"), (F.col("walk") % 4).cast("string")).alias("segment"), "cell").agg(F.count("*").alias("v"))
    out = curves.branch_preference(v, _pt(spark, sf_dir).select("cell", "pseudotime"), ["s0"], ["s1"], ["s0", "s1", "s2"], ["s3"])
    return out.select("cell", *[_r(c).alias(c) for c in ("preference", "parent_preference", "visited", "pseudotime")])


@query(f"""with {XYZ}, d as (select a.cell, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) dist from p a join p b on a.cell <> b.cell),
r as (select *, row_number() over (partition by cell order by dist) k from d) select cell, round(dist, 6) n_dist from r where k = 9""")
def layout_density(spark, sf_dir):
    return curves.layout_density(_points(spark, sf_dir), _scratch(spark, "density"), 10).withColumn("n_dist", F.round("n_dist", 6))


@query(f"""with {XYZ}, o as (select *, row_number() over (partition by label order by z desc, cell) r from p), t as (select label, max(x) filter (r = 1) x1, max(y) filter (r = 1) y1, max(z) filter (r = 1) z1, max(x) filter (r = 5) x5, max(y) filter (r = 5) y5, max(z) filter (r = 5) z5 from o group by 1),
l as (select *, 5 / sqrt((x5 - x1) * (x5 - x1) + (y5 - y1) * (y5 - y1) + (z5 - z1) * (z5 - z1)) s from t) select label::varchar segment, round(x1 + s * (x5 - x1), 5) x, round(y1 + s * (y5 - y1), 5) y, round(z1 + s * (z5 - z1), 5) z from l where s is not null""")
def tip_labels(spark, sf_dir):
    d = _points(spark, sf_dir).withColumnRenamed("grp", "segment").withColumn("pseudotime", F.col("z"))
    return curves.tip_labels(d, 5.0).select("segment", *[_r(c, 5).alias(c) for c in "xyz"])


FORCE = f"""{{}}{SQL['t1']}, vd as (select vec_id cell, [floor(100 * abs(embedding[1]::double)), floor(100 * abs(embedding[2]::double)), floor(100 * abs(embedding[3]::double)), floor(100 * abs(embedding[4]::double)), abs(embedding[5]::double)] e, abs(embedding[5]::double) pt, 'n' || (vec_id % 25) s from embeddings),
vp as (select cell, pt, s, list_transform(e, lambda v: v / list_sum(e)) e from vd where list_sum(e) >= 1), kd as (select a.cell, b.cell nbr, list_distance(a.e, b.e) dist from vp a join vp b on a.cell <> b.cell), kn as materialized (select *, row_number() over (partition by cell order by dist, nbr) rank from kd qualify rank <= 40),
fc as (select quantile_cont(dist, 0.75) + 1.5 * (quantile_cont(dist, 0.75) - min(dist)) f from kn where rank = 2), ea as (select * from kn where cell in (select cell from kn, fc where rank = 2 and dist <= f)), fe as (select quantile_cont(dist, 0.75) + 1.2 * (quantile_cont(dist, 0.75) - min(dist)) f from ea),
sg as (select distinct child s, parent p from t1), fg as materialized (select ea.cell a, nbr b, dist, 1 / dist weight from ea join vp x on x.cell = ea.cell join vp y on y.cell = nbr join sg m on m.s = x.s join sg n on n.s = y.s, fe where dist <= f and abs(x.pt - y.pt) <= 0.2 and (x.s = y.s or m.p = n.p))"""


def _force(spark, sf_dir):
    """(profiles' neighbours, pseudotime, edges of cells that are near in all ways)."""
    v, scratch = fx.vectors(spark, sf_dir), _scratch(spark, "force")
    long = v.select("cell", F.posexplode(F.slice("vec", 1, 4)).alias("tip", "x")).select("tip", "cell", F.floor(100 * F.abs("x")).alias("v"))
    pt = v.select("cell", F.abs(F.get("vec", 4)).alias("pseudotime"))
    segment = v.select("cell", F.concat(F.lit("n"), (F.col("cell") % 25).cast("string")).alias("segment"))
    knn = scratch.table(neighbors.knn_exact(layout.visit_profiles(long, pt), 40, _scratch(spark, "knn")), "near")
    return knn, pt, layout.neighbor_edges(knn, pt, scratch, segment, fx.tree(spark, sf_dir), cut_cells=1.5, cut_edges=1.2, max_pt_diff=0.2), scratch


@query(f"with {FORCE.format('')} select a, b, round(dist, 6) dist, round(weight, 3) weight from fg")
def force_edges(spark, sf_dir):
    return _force(spark, sf_dir)[2].select("a", "b", F.round("dist", 6).alias("dist"), F.round("weight", 3).alias("weight"))


def _peel_sql(rounds: int, least: int) -> str:
    """So many rounds, of which those after the last change leave all as it is."""
    return ", ".join(f"c{i} as materialized (select a, count(*) filter (dist > 0) >= {least} ok from e{i} group by 1), e{i + 1} as materialized (select * from e{i} where (select bool_and(ok) from c{i}) or (a in (select a from c{i} where ok) and b in (select a from c{i} where ok)))" for i in range(rounds))


@query(f"with {FORCE.format('')}, e0 as (select * from fg), {_peel_sql(24, 3)} select a, b, round(dist, 6) dist from e24")
def force_graph(spark, sf_dir):
    _, _, edges, scratch = _force(spark, sf_dir)
    return layout.peel(edges, 3, scratch).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"with {FORCE.format('')} select kn.cell, round(sum(vp.pt / dist) / sum(1 / dist), 6) neighbor_pt from kn join vp on vp.cell = nbr group by 1")
def neighbor_times(spark, sf_dir):
    knn, pt, _, _ = _force(spark, sf_dir)
    return layout.neighbor_time(knn, pt).withColumn("neighbor_pt", F.round("neighbor_pt", 6))


@query()
def force_layout(spark, sf_dir):
    knn, pt, edges, scratch = _force(spark, sf_dir)
    places = layout.force_layout(layout.undirected(layout.peel(edges, 3, scratch)), _scratch(spark, "layout"), rounds=12)
    return layout.telescope(places, layout.neighbor_time(knn, pt))


@query(f"""with recursive {KNN}, nb as (select cell, list(dist * dist order by dist) d2 from kn where rank <= 15 group by 1), be as (select cell, list_transform(d2, lambda v: v - d2[1]) d, -40.0::double lo, 40.0::double hi, 0 k from nb
union all select cell, d, case when h > ln(5) then mid else lo end, case when h > ln(5) then hi else mid end, k + 1 from (select *, (lo + hi) / 2 mid, ln(list_sum(list_transform(d, lambda v: exp(-exp((lo + hi) / 2) * v)))) + list_sum(list_transform(d, lambda v: exp((lo + hi) / 2) * v * exp(-exp((lo + hi) / 2) * v))) / list_sum(list_transform(d, lambda v: exp(-exp((lo + hi) / 2) * v))) h from be where k < 60)),
bt as (select cell, exp((lo + hi) / 2) beta from be where k = 60), e as (select cell, nbr, exp(-beta * (dist * dist - min(dist * dist) over (partition by cell))) w from kn join bt using (cell) where rank <= 15), s as (select cell i, nbr j, w / sum(w) over (partition by cell) p from e),
b as (select i, j, sum(p) p from (select * from s union all select j, i, p from s) group by 1, 2) select i, j, round(p / (2 * (select count(*) from bt)), 9) p from b""")
def tsne_affinities(spark, sf_dir):
    return embed.affinities(_knn(spark, sf_dir, 15), 5.0).withColumn("p", F.round("p", 9))


@query()
def tsne_places(spark, sf_dir):
    return embed.tsne(embed.affinities(_knn(spark, sf_dir, 30), 10.0), _scratch(spark, "tsne"), rounds=16)


# cells and batches -----------------------------------------------------------------------------------


@query("select c_mktsegment tip, c_custkey cell, count(*) over (partition by c_mktsegment) n from customer where c_mktsegment is not null")
def tip_cells(spark, sf_dir):
    groups = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"))
    cells, tips = tree.tip_cells(groups)
    return cells.join(tips, "tip")


@query(f"""with {SQL['e1']}, k as (select vec_id cell, m from embeddings, (values ('1'), ('5'), ('9')) t(m) where vec_id % 10 = 0) select k.cell, m as module, round(coalesce(value, 0), 6) v, coalesce(value, 0) >= 0.2 above from k left join c1 on c1.cell = k.cell and gene = m""")
def modules_in_cells(spark, sf_dir):
    out = expression.modules_in_cells(_modules(spark, sf_dir), fx.vectors(spark, sf_dir).where("cell % 10 = 0").select("cell"), ["1", "5", "9"], 0.2)
    return out.withColumn("v", F.round("v", 6))


@query(f"""with recursive {SQL['e1']}, ba as (select vec_id cell, vec_id % 3 b from embeddings), nb as (select b, count(*)::double n from ba group by 1), nt as (select count(*) nn, (select ceil(max(value)) + 1 from c1) hi from ba),
su as (select gene, b, sum(value) s1, sum(value * value) s2 from c1 join ba using (cell) group by 1, 2), ev as (select ge.gene, nb.b, n, coalesce(s1, 0) s1, coalesce(s2, 0) s2 from (select distinct gene from c1) ge cross join nb left join su on su.gene = ge.gene and su.b = nb.b),
gm as (select gene, sum(s1) / any_value(nn) gm, sum(s2 - s1 * s1 / n) / any_value(nn) pv from ev, nt group by 1), ga as (select gene, b, n, gm, pv, (s1 / n - gm) / sqrt(pv) g, (s2 - s1 * s1 / n) / (n - 1) / pv d, (s2 - s1 * s1 / n + n * (s1 / n - gm) * (s1 / n - gm)) / pv q from ev join gm using (gene)),
pr as (select b, avg(g) gb, var_samp(g) t2, avg(d) m, var_samp(d) v from ga group by 1), pa as (select ga.*, gb, t2, (2 * v + m * m) / v ap, (m * v + m * m * m) / v bp from ga join pr using (b)),
it as (select gene, b, g gs, d ds, 0 k from pa union all select gene, b, ng, (0.5 * (q - 2 * ng * n * g + n * ng * ng) + bp) / (n / 2 + ap - 1), k + 1 from (select pa.*, k, (t2 * n * g + ds * gb) / (t2 * n + ds) ng from it join pa using (gene, b) where k < 30)),
ad as (select ba.cell, pa.gene, (coalesce(value, 0) - gm - gs * sqrt(pv)) / sqrt(ds) + gm y from ba join pa using (b) join it on it.gene = pa.gene and it.b = pa.b and k = 30 left join c1 on c1.cell = ba.cell and c1.gene = pa.gene)
select cell, gene, round(least(y, hi), 4) as value from ad, nt where y >= 0.05""")
def batch_corrected(spark, sf_dir):
    batches = fx.vectors(spark, sf_dir).select("cell", (F.col("cell") % 3).alias("batch"))
    return batch.combat(fx.clamped(spark, sf_dir), batches)


@query(f"""with recursive {SQL['e1']}, ba as (select vec_id cell, vec_id % 3 b from embeddings), nb as (select b, count(*)::double n from ba group by 1), nt as (select count(*) nn, (select ceil(max(value)) + 1 from c1) hi from ba),
su as (select gene, b, sum(value) s1, sum(value * value) s2 from c1 join ba using (cell) group by 1, 2), ev as (select ge.gene, nb.b, n, coalesce(s1, 0) s1, coalesce(s2, 0) s2 from (select distinct gene from c1) ge cross join nb left join su on su.gene = ge.gene and su.b = nb.b),
gm as (select gene, s1 / n gm, (s2 - s1 * s1 / n) / n pv from ev where b = 0 and s2 - s1 * s1 / n > 1e-12), ga as (select gene, b, n, gm, pv, (s1 / n - gm) / sqrt(pv) g, (s2 - s1 * s1 / n) / (n - 1) / pv d, (s2 - s1 * s1 / n + n * (s1 / n - gm) * (s1 / n - gm)) / pv q from ev join gm using (gene)),
pr as (select b, avg(g) gb, var_samp(g) t2, avg(d) m, var_samp(d) v from ga group by 1), pa as (select ga.*, gb, t2, (2 * v + m * m) / v ap, (m * v + m * m * m) / v bp from ga join pr using (b)),
it as (select gene, b, g gs, d ds, 0 k from pa union all select gene, b, ng, (0.5 * (q - 2 * ng * n * g + n * ng * ng) + bp) / (n / 2 + ap - 1), k + 1 from (select pa.*, k, (t2 * n * g + ds * gb) / (t2 * n + ds) ng from it join pa using (gene, b) where k < 30)),
ad as (select ba.cell, pa.gene, case when ba.b = 0 then coalesce(value, 0) else (coalesce(value, 0) - gm - gs * sqrt(pv)) / sqrt(ds) + gm end y from ba join pa using (b) join it on it.gene = pa.gene and it.b = pa.b and k = 30 left join c1 on c1.cell = ba.cell and c1.gene = pa.gene)
select cell, gene, round(least(y, hi), 4) as value from ad, nt where y >= 0.05""")
def batch_corrected_reference(spark, sf_dir):
    batches = fx.vectors(spark, sf_dir).select("cell", (F.col("cell") % 3).alias("batch"))
    return batch.combat(fx.clamped(spark, sf_dir), batches, reference=0)


BATCHES = "v as (select vec_id cell, embedding::double[] e from embeddings), u as (select cell, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from v), ab as (select a.cell a, b.cell b, list_distance(a.e, b.e) d from u a join u b on a.cell % 3 = 0 and b.cell % 3 <> 0), mp as (select a, b from (select *, row_number() over (partition by a order by d, b) r from ab) where r <= 20 intersect select a, b from (select *, row_number() over (partition by b order by d, a) r from ab) where r <= 20)"


def _batches(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("cell", "vec")
    return v.where("cell % 3 = 0"), v.where("cell % 3 <> 0")


@query(f"with {BATCHES} select a, b from mp")
def mutual_neighbors(spark, sf_dir):
    one, other = _batches(spark, sf_dir)
    return integrate.mutual_pairs(integrate.unit_vectors(one), integrate.unit_vectors(other), 20, _scratch(spark, "mutual"))


@query(f"""with {BATCHES}, {SQL['e1']}, pb as (select b, count(*) n from mp group by 1), ds as (select x.cell, y.cell b, list_distance(x.e, y.e) d from u x join u y on x.cell % 3 <> 0 join pb on pb.b = y.cell),
nr as (select *, min(d) over (partition by cell) d0 from ds qualify row_number() over (partition by cell order by d, b) <= 50), wt as (select cell, b, exp(-(d * d - d0 * d0)) w from nr), tg as (select b, gene, sum(value) s from mp join c1 on c1.cell = a group by 1, 2),
mv as (select g.b, g.gene, coalesce(tg.s / n, 0) - coalesce(c1.value, 0) m from (select b, gene from tg union select b, gene from pb join c1 on c1.cell = b) g join pb using (b) left join tg on tg.b = g.b and tg.gene = g.gene left join c1 on c1.cell = g.b and c1.gene = g.gene),
sh as (select cell, gene, sum(w * m) / any_value(t) s from wt join mv using (b) join (select cell, sum(w) t from wt group by 1) using (cell) group by 1, 2)
select cell, gene, round(value, 5) as value from (select cell, gene, value from c1 where cell % 3 = 0 union all select cell, gene, coalesce(value, 0) + coalesce(s, 0) from (select cell, gene, value from c1 where cell % 3 <> 0) full join sh using (cell, gene)) where value >= 0.05""")
def mutual_corrected(spark, sf_dir):
    one, other = _batches(spark, sf_dir)
    return integrate.mutual_correction(fx.clamped(spark, sf_dir).select("cell", "gene", "value"), one, other, _scratch(spark, "mutual")).withColumn("value", F.round("value", 5))


#: Modules are labels of vectors in five stages; weights of genes and levels of cells come from the components.
STAGED = f"""{SQL['e1']}, wt as (select cell % 5 stage, grp module, gene, sum(value) w from c1 group by 1, 2, 3), hv as (select distinct stage, gene from wt), gp as (select * from (values (1), (2)) t(gap)),
wa as (select gap, wt.stage, module, wt.gene, w / max(w) over (partition by gap, wt.stage, module) w from wt cross join gp join hv on hv.stage = wt.stage + gap and hv.gene = wt.gene), wb as (select gap, wt.stage, module, wt.gene, w / max(w) over (partition by gap, wt.stage, module) w from wt cross join gp join hv on hv.stage = wt.stage - gap and hv.gene = wt.gene),
la as (select gap, stage f, module a, gene, w, sum(w) over (partition by gap, stage, module) t from (select *, row_number() over (partition by gap, stage, module order by w desc, gene) r from wa) where r <= 12),
lb as (select gap, stage - gap f, module b, gene, w, sum(w) over (partition by gap, stage, module) t from (select *, row_number() over (partition by gap, stage, module order by w desc, gene) r from wb) where r <= 12),
ov as materialized (select la.gap, la.f, a, b, (sum(la.w) + sum(lb.w)) / (any_value(la.t) + any_value(lb.t)) score from la join lb on la.gap = lb.gap and la.f = lb.f and la.gene = lb.gene group by la.gap, la.f, a, b)"""
LINKED = f"""{STAGED}, kp as (select f stage, a module from ov where gap = 1 and score > 0.2 union select f + 1, b from ov where gap = 1 and score > 0.2),
b1 as (select f + 1 t, b, arg_min({{'a': a, 's': score}}, {{'n': -score, 'a': a}}) x from ov where gap = 1 and score > 0.2 and (f, a) in (select (stage, module) from kp) and (f + 1, b) in (select (stage, module) from kp) group by 1, 2), b2 as (select f + 2 t, b, arg_min({{'a': a, 's': score}}, {{'n': -score, 'a': a}}) x from ov where gap = 2 and score > 0.2 group by 1, 2),
ch as (select t, b, b1.x x1, b2.x x2, b1.x is null or coalesce(b1.x.s < 0.4 and b2.x.s > 0.42, false) far from b1 full join b2 using (t, b)),
lk as materialized (select t - case when far then 2 else 1 end from_stage, case when far then x2.a else x1.a end a, t to_stage, b, case when far then x2.s else x1.s end score from ch)"""


def _staged(spark, sf_dir):
    c = fx.clamped(spark, sf_dir).join(fx.vectors(spark, sf_dir).select("cell", F.col("grp").alias("module")), "cell")
    weights = c.groupBy((F.col("cell") % 5).alias("stage"), "module", "gene").agg(F.sum("value").alias("w"))
    return weights, [stages.overlaps(weights, g, 12) for g in (1, 2)]


def _links(spark, sf_dir):
    _, (one, two) = _staged(spark, sf_dir)
    return stages.connections(one, two, 0.2, 0.4, 0.42)


@query(f"with {STAGED} select f from_stage, f + gap to_stage, a, b, round(score, 6) score from ov")
def module_overlaps(spark, sf_dir):
    one, two = _staged(spark, sf_dir)[1]
    return one.union(two).withColumn("score", F.round("score", 6))


@query(f"with {LINKED} select from_stage, a, to_stage, b, round(score, 6) score from lk")
def module_links(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("score", F.round("score", 6))


CHAINED = f"""{LINKED}, en as (select to_stage, b from lk where (to_stage, b) not in (select (from_stage, a) from lk)), up as (select to_stage es, b e, to_stage st, b m, 0 k, 0.0::double s from en union all select es, e, from_stage, a, k + 1, s + score from up join lk on to_stage = st and b = m),
go as (select es, e, max_by(s / nullif(k, 0), k) mean_score from up group by 1, 2 having max_by(s / nullif(k, 0), k) >= 0.38), cn as (select es, e, st, m, mean_score from up join go using (es, e))"""


@query(f"with recursive {CHAINED} select es end_stage, e as \"end\", st stage, m as module, round(mean_score, 6) mean_score from cn")
def module_chains(spark, sf_dir):
    return stages.chains(_links(spark, sf_dir), _scratch(spark, "chains"), 0.38).withColumn("mean_score", F.round("mean_score", 6))


@query(f"""with recursive {CHAINED}, lv as (select cell % 5 stage, (gene::int % 10)::varchar as module, cell, sum(value) v from c1 group by 1, 2, 3), ls as (select stage, module, cell, v / max(v) over (partition by stage, module) v from lv)
select es end_stage, e as "end", cell, round(sum(v), 6) as level from cn join ls on ls.stage = st and ls.module = m group by 1, 2, 3""")
def module_programmes(spark, sf_dir):
    levels = fx.clamped(spark, sf_dir).groupBy((F.col("cell") % 5).alias("stage"), (F.col("gene").cast("int") % 10).cast("string").alias("module"), "cell").agg(F.sum("value").alias("v"))
    chained = stages.chains(_links(spark, sf_dir), _scratch(spark, "chains"), 0.38)
    return stages.programmes(chained, levels).withColumn("level", F.round("level", 6))


def _mixture_sql(rounds: int) -> str:
    """So many rounds of expectation and maximisation, one after another."""
    pdf = lambda m, s: f"exp(-power((x - {m}) / {s}, 2) / 2) / ({s} * sqrt(2 * pi()))"
    steps = ["r0 as (select gene, 0.95 w, avg(x) filter (x < 0.1) a, avg(x) filter (x > 0.2) b, stddev_pop(x) s, stddev_pop(x) t from vx group by 1 having count(*) filter (x < 0.1) > 0 and count(*) filter (x > 0.2) > 0 and stddev_pop(x) > 0)"]
    for k in range(rounds):
        steps.append(f"p{k} as (select gene, x, w * {pdf('a', 's')} d1, (1 - w) * {pdf('b', 't')} d2 from vx join r{k} using (gene)), q{k} as (select gene, x, d1 / (d1 + d2) r, ln(d1 + d2) l from p{k}), r{k + 1} as materialized (select gene, avg(r) w, sum(r * x) / sum(r) a, sum((1 - r) * x) / sum(1 - r) b, sqrt(sum(r * x * x) / sum(r) - power(sum(r * x) / sum(r), 2)) s, sqrt(sum((1 - r) * x * x) / sum(1 - r) - power(sum((1 - r) * x) / sum(1 - r), 2)) t, sum(l) l from q{k} group by 1)")
    return ", ".join(steps)


@query(f"with {SQL['e1']}, vx as (select gene, value x from c1), {_mixture_sql(8)} select gene as key, round(l, 4) likelihood, round(w, 5) weight_low, round(a, 5) mean_low, round(b, 5) mean_high, round(s, 5) sd_low, round(t, 5) sd_high from r8")
def module_mixtures(spark, sf_dir):
    values = fx.clamped(spark, sf_dir).select(F.col("gene").alias("key"), F.col("value").alias("x"))
    fit = integrate.mixture_rounds(values, _scratch(spark, "mixture"), 0.1, 0.2, rounds=8, tolerance=float("-inf"))
    return fit.select("key", F.round("likelihood", 4).alias("likelihood"), *[F.round(c, 5).alias(c) for c in ("weight_low", "mean_low", "mean_high", "sd_low", "sd_high")])


@query(f"""with {CREATED}, gp as (select tot.cell, c_mktsegment grp from tot join customer on c_custkey::varchar = tot.cell), me as (select c_mktsegment grp, gene, sum(value) / any_value(n) m from ex join customer on c_custkey::varchar = ex.cell join (select c_mktsegment, count(*) n from customer group by 1) using (c_mktsegment) group by 1, 2),
gn as (select distinct gene from me), fu as (select grp, gene, coalesce(m, 0) m from (select distinct grp from me) cross join gn left join me using (grp, gene)), di as (select a.grp g1, b.grp g2, sum((a.m - b.m) * (a.m - b.m)) d from fu a join fu b on a.gene = b.gene and a.grp <> b.grp group by 1, 2),
ne as (select g1, arg_min(g2, d) g2 from di group by 1), pr as (select distinct least(g1, g2) g1, greatest(g1, g2) g2 from ne), sd as (select g1 || '-' || g2 cmp, cell, 1 side from pr join gp on grp = g1 union all select g1 || '-' || g2, cell, 2 from pr join gp on grp = g2), {_binom_sql('sd', 'greatest(frac_1, frac_2) >= 0.1')}
select g1, g2, (select count(*) from bi where cmp = g1 || '-' || g2) n_genes from pr""")
def cluster_de(spark, sf_dir):
    c, groups = _created(spark, sf_dir), _segments(spark, sf_dir)
    means = c.expr.join(groups, "cell").groupBy("grp", "gene").agg(F.sum("value").alias("s")).join(expression.group_sizes(groups), "grp").select("grp", "gene", (F.col("s") / F.col("n")).alias("m"))
    return markers.cluster_de(c.expr, c.counts, groups.join(c.cells, "cell", "left_semi"), means, effect=0.0, p_max=1.0)[0]


# data of plots -----------------------------------------------------------------------------------------


@query(f"with {XYZ} select cell, round(x, 6) x, round(y, 6) y, case when label <> 0 then label::varchar end as grp from p")
def labelled_points(spark, sf_dir):
    p = _points(spark, sf_dir)
    return views.labelled(p.select("cell", _r("x").alias("x"), _r("y").alias("y")), p.where("grp <> '0'").select("cell", "grp"))


@query(f"""with {XYZ}, e as (select vec_id a, vec_id * 7 % (select count(*) from embeddings) b, vec_id % 5 + 1.0 w from embeddings)
select a, b, round(p.x, 6) x1, round(p.y, 6) y1, round(q.x, 6) x2, round(q.y, 6) y2, round(w / (select max(w) from e) * 0.4, 6) alpha from e join p on p.cell = a join p q on q.cell = b""")
def drawn_edges(spark, sf_dir):
    p = _points(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    e = p.crossJoin(n).select(F.col("cell").alias("a"), (F.col("cell") * 7 % F.col("n")).alias("b"), (F.col("cell") % 5 + 1.0).alias("w"))
    return views.drawn_edges(p, e, 0.4).select("a", "b", *[_r(c).alias(c) for c in ("x1", "y1", "x2", "y2", "alpha")])


@query(f"""with {XYZ}, m as (select quantile_cont(x, 0.975) filter (x > 0) mx, quantile_cont(y, 0.975) filter (y > 0) my from p)
select cell, round(least(greatest(x / mx, 0), 1), 6) red, round(least(greatest(y / my, 0), 1), 6) green from p, m""")
def two_colors(spark, sf_dir):
    p = _points(spark, sf_dir).select("cell", F.col("x").alias("red"), F.col("y").alias("green"))
    return views.two_colors(p).select("cell", _r("red").alias("red"), _r("green").alias("green"))


@query("select vec_id cell, a::int dim_x, b::int dim_y, round(embedding[a]::double, 6) x, round(embedding[b]::double, 6) y from embeddings, (values (1, 2), (3, 4), (5, 1)) t(a, b)")
def dimension_pairs(spark, sf_dir):
    out = views.dimension_pairs(fx.vectors(spark, sf_dir), [(1, 2), (3, 4), (5, 1)])
    return out.withColumns({"x": _r("x"), "y": _r("y")})


@query(f"with {XYZ} select label::varchar as grp, count(*) n from (select label from p order by sqrt((x - 0.1) * (x - 0.1) + (y + 0.05) * (y + 0.05)), cell limit 40) group by 1")
def groups_near(spark, sf_dir):
    return views.groups_near(_points(spark, sf_dir), 0.1, -0.05, 40)


@query(f"with {XYZ} select cell, label::varchar as grp, l as label, round(v, 6) as value from (select cell, label, 'x' l, x v from p union all select cell, label, 'y', y from p)")
def labels_by_group(spark, sf_dir):
    p = _points(spark, sf_dir)
    return views.by_group(p.select("cell", "x", "y"), ["x", "y"], p.select("cell", "grp")).withColumn("value", _r("value"))


@query("""with v as (select c_mktsegment grp, c_acctbal::double v from customer), r as (select min(v) lo, max(v) hi from v), b as (select grp, least(floor((v - lo) / (hi - lo) * 20), 19)::int bin, lo, hi from v, r)
select grp, bin, round(lo + (bin + 0.5) * (hi - lo) / 20, 6) as at, count(*) n, round(count(*) / sum(count(*)) over (partition by grp), 6) share from b group by grp, bin, lo, hi""")
def group_histograms(spark, sf_dir):
    v = fx.load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").cast("double").alias("value"))
    return views.group_histograms(v, 20).withColumns({"at": _r("at"), "share": _r("share")})


#: Published rules of binned kernel density estimates: linear binning, a bell cut at 3.4 bandwidths.
GRID = f"""{XYZ}, q as (select x, y from p where x > 0 or y > 0), hw as (select count(*) n, min(x) ax, max(x) bx, min(y) ay, max(y) by_, (quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 30 hx, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 30 hy from q),
sz as (select n, hx, hy, ax - 1.5 * hx lx, ay - 1.5 * hy ly, (bx - ax + 3 * hx) / 31 dx, (by_ - ay + 3 * hy) / 31 dy from hw), u as (select (x - lx) / dx ux, (y - ly) / dy uy from q, sz),
g as (select (floor(ux) + a)::int i, (floor(uy) + b)::int j, sum((case a when 1 then ux - floor(ux) else 1 - ux + floor(ux) end) * (case b when 1 then uy - floor(uy) else 1 - uy + floor(uy) end)) w from u, range(0, 2) r(a), range(0, 2) s(b) group by 1, 2),
kx as (select k, exp(-(k * dx / hx) * (k * dx / hx) / 2) e, dx d from sz, range(-31, 32) r(k) where abs(k) <= floor(3.4 * hx / dx)), ky as (select k, exp(-(k * dy / hy) * (k * dy / hy) / 2) e, dy d from sz, range(-31, 32) r(k) where abs(k) <= floor(3.4 * hy / dy)),
fx as (select i + k i, j, sum(w * e / ((select sum(e) from kx) * d)) w from g, kx group by 1, 2), fy as (select i, j + k j, sum(w * e / ((select sum(e) from ky) * d)) w from fx, ky group by 1, 2)"""


@query(f"with {GRID} select i::int i, j::int j, round(lx + i * dx, 6) x, round(ly + j * dy, 6) y, round(power(w / n, 0.25), 5) density from fy, sz where i between 0 and 31 and j between 0 and 31")
def density_grid(spark, sf_dir):
    out = views.density_grid(_points(spark, sf_dir), bins=32)
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), _r("x").alias("x"), _r("y").alias("y"), _r("density", 5).alias("density"))


@query(f"""with {NODES}, la as (select segment, arg_max(node, k) a from nd group by 1), jn as (select * from (values ('view', 'click'), ('view', 'purchase'), ('click', 'cart')) t(parent, child)),
e as (select node a, b from (select node, lead(node) over (partition by segment order by k) b from nd) where b is not null union all select a, node b from jn join la on la.segment = parent join nd on nd.segment = child and k = 1),
m as (select segment || '-' || k b, log2(avg(power(2, pt) - 1) + 1) v from ng group by 1) select a, b, round(v, 6) as value from e join m using (b)""")
def tree_values(spark, sf_dir):
    cells, summary = _nodes(spark, sf_dir)
    joins = spark.createDataFrame([("view", "click"), ("view", "purchase"), ("click", "cart")], "parent string, child string")
    v = _pt(spark, sf_dir).select("cell", F.col("pseudotime").alias("value"))
    return views.tree_values(v, cells.select("cell", "node"), tree.node_edges(summary, joins).select("a", "b")).withColumn("value", _r("value"))


@query(f"""with {NODES}, jn as (select * from (values ('view', 'click'), ('view', 'purchase'), ('click', 'cart')) t(parent, child)), la as (select segment, arg_max(node, k) a from nd group by 1), px as (select * from (values ('view', 1.5), ('click', 1.0), ('purchase', 2.0), ('cart', 1.0)) t(segment, x)),
ed as (select node a, b from (select node, lead(node) over (partition by segment order by k) b from nd) where b is not null union all select a, node b from jn join la on la.segment = parent join nd on nd.segment = child and k = 1),
li as (select a node_1, b node_2, p.segment segment_1, q.segment segment_2, p.max_pt y1, q.max_pt y2 from ed join nd p on p.node = a join nd q on q.node = b union all select 'view-0', node, segment, segment, 0, max_pt from nd where segment = 'view' and k = 1),
xy as (select li.*, p.x::double x1, q.x::double x2 from li join px p on p.segment = segment_1 join px q on q.segment = segment_2)
select node_1, node_2, segment_1, segment_2, x1, round(y1, 6) y1, x2, round(y2, 6) y2, false do_mean from xy where x1 = x2 union all select node_1, segment_2 || '-0', segment_1, segment_2, x1, round(y1, 6), x2, round(y1, 6), true from xy where x1 <> x2
union all select segment_2 || '-0', node_2, segment_2, segment_2, x2, round(y1, 6), x2, round(y2, 6), false from xy where x1 <> x2""")
def elaborated_tree(spark, sf_dir):
    joins = spark.createDataFrame([("view", "click"), ("view", "purchase"), ("click", "cart")], "parent string, child string")
    summary = _nodes(spark, sf_dir)[1]
    places = spark.createDataFrame([("view", 1.5), ("click", 1.0), ("purchase", 2.0), ("cart", 1.0)], "segment string, x double")
    return tree.elaborate_layout(tree.node_edges(summary, joins).select("a", "b"), summary, places, "view").withColumns({"y1": _r("y1"), "y2": _r("y2")})


@query(f"""with {NODES}, la as (select segment, arg_max(node, k) a from nd group by 1), jn as (select * from (values ('view', 'click'), ('view', 'purchase'), ('click', 'cart')) t(parent, child)),
e as (select node a, b from (select node, lead(node) over (partition by segment order by k) b from nd) where b is not null union all select a, node b from jn join la on la.segment = parent join nd on nd.segment = child and k = 1),
vi as (select cell, count(*) / 100.0 v from w1 group by 1), m as (select ng.segment || '-' || k b, log2(avg(power(2, pt) - 1) + 1) r, log2(avg(power(2, v) - 1) + 1) g from ng join vi using (cell) group by 1), d as (select a, e.b, r, g from e join m using (b)), q as (select quantile_cont(r, 0.975) filter (r > 0) mr, quantile_cont(g, 0.975) filter (g > 0) mg from d)
select a, b, round(least(greatest(r / mr, 0), 1), 6) red, round(least(greatest(g / mg, 0), 1), 6) green from d, q""")
def tree_two_colors(spark, sf_dir):
    cells, summary = _nodes(spark, sf_dir)
    joins = spark.createDataFrame([("view", "click"), ("view", "purchase"), ("click", "cart")], "parent string, child string")
    time = _pt(spark, sf_dir).select("cell", F.col("pseudotime").alias("value"))
    visits = fx.walks(spark, sf_dir).groupBy("cell").agg((F.count("*") / 100).alias("value"))
    out = views.tree_two_colors(time, visits, cells.select("cell", "node"), tree.node_edges(summary, joins).select("a", "b"))
    return out.select("a", "b", _r("red").alias("red"), _r("green").alias("green"))


@query()
def built_tree(spark, sf_dir):
    v = fx.walks(spark, sf_dir).groupBy((F.col("walk") % 4 + 1).alias("segment"), "cell").agg(F.count("*").cast("double").alias("v"))
    pt = _pt(spark, sf_dir).select("cell", "pseudotime")
    tips = pt.orderBy(F.desc("pseudotime"), "cell").limit(8).select((F.pmod(F.xxhash64("cell"), F.lit(4)) + 1).alias("tip"), "cell")
    return tree.assemble(v, pt, tips, _scratch(spark, "tree"), threshold=0.4, node_size=4, cuts=8, width=3).lines


@query("select case when min(c_acctbal) < 0 then -greatest(abs(min(c_acctbal)), abs(max(c_acctbal))) else min(c_acctbal) end::double low, case when min(c_acctbal) < 0 then greatest(abs(min(c_acctbal)), abs(max(c_acctbal))) else max(c_acctbal) end::double high from customer")
def color_limits(spark, sf_dir):
    return views.color_limits(fx.load(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("value")))


@query(f"with {PAIRS} select m1, m2, fh frac_high, round_even(fl - fh, 4) frac_diff, fh <= 0.15 and round_even(fl - fh, 4) <= 0.3 chosen, m1 in ('1', '5', '9') and m2 in ('1', '5', '9') highlighted from pr")
def module_thresholds(spark, sf_dir):
    return views.pair_thresholds(expression.doublet_pairs(_modules(spark, sf_dir), 0.2, 0.1), 0.15, 0.3, ["1", "5", "9"])


@query(f"""with {SQL['e1']}, k as (select vec_id cell, m1, m2 from embeddings, (values ('1', '5'), ('5', '9')) t(m1, m2) where vec_id % 3 = 0)
select k.cell, m1, m2, round(coalesce(a.value, 0), 6) v1, round(coalesce(b.value, 0), 6) v2 from k left join c1 a on a.cell = k.cell and a.gene = m1 left join c1 b on b.cell = k.cell and b.gene = m2 where a.value is not null or b.value is not null""")
def module_pair_values(spark, sf_dir):
    pairs = spark.createDataFrame([("1", "5"), ("5", "9")], "m1 string, m2 string")
    out = views.pair_values(_modules(spark, sf_dir), fx.vectors(spark, sf_dir).where("cell % 3 = 0").select("cell"), pairs)
    return out.withColumns({"v1": _r("v1"), "v2": _r("v2")})


TIMING = "tm as (select p_partkey gene, case when p_partkey % 5 > 0 then p_partkey % 7 / 10.0 end::double time_on, case when p_partkey % 3 > 0 then p_partkey % 11 / 10.0 else 'inf'::double end::double time_off from part)"


@query(f"with {TIMING} select gene, time_on, time_off, row_number() over (order by case when time_on is null and isinf(time_off) then 'inf'::double else time_on end nulls first, time_off, gene)::int as row from tm")
def heatmap_rows(spark, sf_dir):
    k = F.col("p_partkey")
    t = fx.load(spark, sf_dir, "part").select(k.alias("gene"), F.when(k % 5 > 0, k % 7 / 10).alias("time_on"), F.when(k % 3 > 0, k % 11 / 10).otherwise(float("inf")).alias("time_off"))
    return views.heatmap_rows(t)


@query("with w as (select n_nationkey as window, (n_nationkey * n_nationkey / 600.0)::double pt from nation), h as (select t, min(w.window) as window from w, range(0, 11) r(t) where pt >= t / 10 group by 1) select h.window, max(t / 10) mark from h group by 1")
def time_marks(spark, sf_dir):
    k = F.col("n_nationkey")
    w = fx.load(spark, sf_dir, "nation").select(k.alias("window"), (k * k / 600).alias("pt"))
    return views.time_marks(w, [i / 10 for i in range(11)])


HOURS = f"{VISITS}, wn as (select distinct cell, s::int as window from w1, range(0, 24) r(s) where split_part(cell, '-', 2)::int between s and s + 2), iv as (select cell, wn.window, coalesce(max(v) filter (segment = 's0'), 0) v1, coalesce(max(v) filter (segment = 's1'), 0) v2 from wn join vs using (cell) where segment in ('s0', 's1') group by 1, 2)"


def _hours(spark, sf_dir):
    """Windows of three hours over the cells of walks."""
    hour = X.cut_string("cell", "-", 2).cast("int")
    starts = F.filter(F.sequence(hour - 2, hour), lambda s: s >= 0)
    return fx.walks(spark, sf_dir).select("cell").distinct().select("cell", F.explode(starts).alias("window"))


@query(f"with {HOURS} select cell, iv.window, 's0' segment, v1 v from iv union all select cell, iv.window, 's1', v2 from iv")
def window_visits(spark, sf_dir):
    return views.window_visits(_visits(spark, sf_dir), _hours(spark, sf_dir), "s0", "s1")


@query(f"with {HOURS} select cell, iv.window, round((v1 - v2) / (v1 + v2), 6) preference from iv")
def window_preferences(spark, sf_dir):
    return views.window_preferences(_visits(spark, sf_dir), _hours(spark, sf_dir), "s0", "s1").withColumn("preference", _r("preference"))


@query(f"""with {XYZ}, r as (select min(abs(x)) lo, (max(abs(x)) - min(abs(x))) * 2 / 9 + min(abs(x)) fr, median(sqrt(abs(y) + 1)) m from p)
select cell, round((0.8 - 0.7 * greatest((fr - abs(x) + lo) / fr, 0)) * sqrt(abs(y) + 1) / m, 6) alpha from p, r""")
def faded_points(spark, sf_dir):
    p = _points(spark, sf_dir).select("cell", F.col("x").alias("value"), (F.abs("y") + 1).alias("n_dist"))
    return views.thinned(views.faded(p)).select("cell", _r("alpha").alias("alpha"))

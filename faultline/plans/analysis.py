"""Registered queries: counts, matrices, ranks and tests (entry C4 of the
original pipeline), over the stand-in views of ``standins``.

Every function takes (spark, sf_dir) and returns a lazy DataFrame; computed
columns carry the same names as the DuckDB oracle in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.labels import edge_sign, edge_width, normalize_key, strip_suffix
from faultline.operators import counts as C
from faultline.operators import stats as S
from faultline.operators.ranks import global_positions, midranks as midranks_op
from faultline.plans.standins import (ATTRS, TYPE_ORDER, bug_matrix, bugs, merged, projects)
from faultline.sources.tables import table

CATEGORIES = TYPE_ORDER + ["total"]
# Custom level list for the domain order (O2); unknown domains sort last.
DOMAIN_ORDER = ["MACHINERY", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
# Strong-pair threshold for the correlation network.
EDGE_THRESHOLD = 0.4
# Dependency categories (order priorities) for the fan-out and cross tests.
DEP_CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Bug type whose count is summed per dependency category.
FANOUT_TYPE = "failure"


def _r6(c):
    return F.round(c, 6)


def project_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project dimension left-joined to the type matrix."""
    dims = projects(spark, sf_dir).select("project", "domain")
    return dims.join(bug_matrix(spark, sf_dir), "project", "left")


def type_counts(spark, sf_dir):
    """F8 A1."""
    return C.type_counts(bugs(spark, sf_dir), "project", "bug_type")


def label_recode(spark, sf_dir):
    """T12."""
    return bugs(spark, sf_dir)


def matrix_long(spark, sf_dir):
    """The zero-filled matrix back in long form."""
    return C.unpivot_long(bug_matrix(spark, sf_dir), ["project"], TYPE_ORDER, "bug_type", "n")


def matrix_summary(spark, sf_dir):
    """Totals and means rows."""
    return C.column_summary(bug_matrix(spark, sf_dir), CATEGORIES, "row_kind")


def type_share(spark, sf_dir):
    """W3."""
    return C.shares(type_counts(spark, sf_dir), "project").withColumn("share", _r6(F.col("share")))


def _supplier_nations(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return sup.select("s_suppkey",
                      F.concat(F.lit("Nation #"), F.col("s_nationkey").cast("string")).alias("nation_raw"))


def _nation_dim(spark, sf_dir):
    nat = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return nat.select(normalize_key("n_name").alias("nation_key"), "n_name", "n_regionkey").distinct()


def key_normalize_join(spark, sf_dir):
    """Facts left-joined to the dimension on the normalized key.
    No hint: the size of the dimension decides at run time."""
    facts = _supplier_nations(spark, sf_dir).withColumn("nation_key", normalize_key("nation_raw"))
    return facts.join(_nation_dim(spark, sf_dir), "nation_key", "left")


def unmatched_keys(spark, sf_dir):
    """Distinct names of customers without any event."""
    names = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").alias("user_id"))
    seen = table(spark, sf_dir, "events").select("user_id")
    return names.join(seen, "user_id", "left_anti").select(F.col("c_name").alias("name")).distinct()


def project_order(spark, sf_dir):
    """Projects that have bugs, by domain level, size desc,
    then id; the position is computed without a single-task window."""
    p = projects(spark, sf_dir).select("project", "domain", "loc")
    p = p.join(bugs(spark, sf_dir).select("project"), "project", "left_semi")
    p = p.withColumn("domain_level", C.level_position("domain", DOMAIN_ORDER))
    order = [F.col("domain_level").asc_nulls_last(), F.col("domain").asc_nulls_last(),
             F.col("loc").desc_nulls_last(), F.col("project").asc()]
    return global_positions(p, order, "position")


def typed_attributes(spark, sf_dir):
    """The typed project dimension."""
    return projects(spark, sf_dir)


def numeric_profile(spark, sf_dir):
    """numeric columns chosen from the schema, profiled in one pass."""
    df = projects(spark, sf_dir)
    from pyspark.sql.types import NumericType
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != "project"]
    long = S.to_long(df, "project", cols, "attribute", "value")
    return long.groupBy("attribute").agg(
        F.count("value").alias("n"), _r6(F.avg("value")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def attribute_overview(spark, sf_dir):
    """Mean skipping NULLs next to the total requiring all values."""
    out = C.mean_and_strict_total(projects(spark, sf_dir), ATTRS)
    return out.withColumn("mean", _r6(F.col("mean"))).withColumn("total", _r6(F.col("total")))


def domain_medians(spark, sf_dir):
    """A5: exact medians per domain; a NULL in a domain gives NULL (stars)."""
    return S.medians_all_present(merged(spark, sf_dir), "domain", CATEGORIES + ["stars"])


def domain_zscores(spark, sf_dir):
    """Median profile per domain (columns named ``<type>_median``,
    suffix stripped after the unpivot) standardized per category."""
    med = S.medians_all_present(merged(spark, sf_dir), "domain", TYPE_ORDER)
    med = med.select("domain", *[F.col(t).alias(f"{t}_median") for t in TYPE_ORDER])
    long = S.to_long(med, "domain", [f"{t}_median" for t in TYPE_ORDER], "category", "median")
    long = long.withColumn("category", strip_suffix("category", "_median"))
    return S.zscores(long, "category", "median").withColumn("z", _r6(F.col("z")))


def domain_matrix(spark, sf_dir):
    """R2: z profile long -> wide, fill 0."""
    z = domain_zscores(spark, sf_dir)
    return C.pivot_wide(z, ["domain"], "category", "z", TYPE_ORDER, fill=0.0)


def domain_distance(spark, sf_dir):
    """ST5: distance between domain z profiles."""
    z = domain_zscores(spark, sf_dir)
    d = S.profile_distance(z, "domain", "category", "z", len(TYPE_ORDER))
    return d.withColumn("distance", _r6(F.col("distance")))


def midranks(spark, sf_dir):
    """Mid ranks of every category over projects."""
    long = S.to_long(bug_matrix(spark, sf_dir), "project", CATEGORIES, "category", "n")
    return midranks_op(long, ["category"], "n", out="rank")


def spearman_attrs(spark, sf_dir):
    """F9 ST1 R5: categories x attributes, listwise complete rows."""
    out = S.spearman_listwise(merged(spark, sf_dir), "project", TYPE_ORDER, ATTRS)
    return out.withColumn("rho", _r6(F.col("rho")))


def corr_transposed(spark, sf_dir):
    """The attribute x category matrix (transpose of spearman_attrs)."""
    long = spearman_attrs(spark, sf_dir)
    return C.pivot_wide(long, ["col_name"], "row_name", "rho", TYPE_ORDER, fill=None) \
            .withColumnRenamed("col_name", "attribute")


def spearman_pvalues(spark, sf_dir):
    """ST2: p-values of the category x attribute correlations."""
    out = S.spearman_listwise(merged(spark, sf_dir), "project", TYPE_ORDER, ATTRS)
    out = S.with_p_values(out)
    return out.select("row_name", "col_name", _r6(F.col("rho")).alias("rho"), "n",
                      _r6(F.col("p_value")).alias("p_value"))


def spearman_types(spark, sf_dir):
    """ST3 R7: category x category, pairwise complete, lower triangle."""
    out = S.spearman_pairwise(bug_matrix(spark, sf_dir), "project", CATEGORIES)
    return out.withColumn("rho", _r6(F.col("rho")))


def corr_edges(spark, sf_dir, threshold: float = EDGE_THRESHOLD):
    """F12 T19 ST6: strong pairs as undirected edges."""
    st = spearman_types(spark, sf_dir)
    return (st.where(F.abs(F.col("rho")) > threshold)
              .select(F.col("row_name").alias("node_a"), F.col("col_name").alias("node_b"), "rho",
                      _r6(edge_width("rho")).alias("width"), edge_sign("rho").alias("sign")))


def _dependency_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    return C.count_matrix(orders.withColumnRenamed("o_custkey", "project"),
                          "project", "o_orderpriority", DEP_CATEGORIES, total=None)


def spearman_cross(spark, sf_dir):
    """ST7: dependency categories x bug categories over projects with bugs;
    a project without dependency rows counts 0 in each."""
    deps = _dependency_counts(spark, sf_dir)
    m = bug_matrix(spark, sf_dir).join(deps, "project", "left").fillna(0, subset=DEP_CATEGORIES)
    out = S.spearman_listwise(m, "project", TYPE_ORDER, DEP_CATEGORIES)
    return out.withColumn("rho", _r6(F.col("rho")))


def fanout_sum(spark, sf_dir):
    """Each dependency row carries its project's count of one bug type;
    summed per (project, dependency category); unmatched projects give 0."""
    deps = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("dep_category"))
    n = C.type_counts(bugs(spark, sf_dir), "project", "bug_type") \
         .where(F.col("bug_type") == FANOUT_TYPE).select("project", "n")
    return (deps.join(n, "project", "left")
                .groupBy("project", "dep_category")
                .agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).alias("type_bugs")))


def kruskal_wallis(spark, sf_dir):
    """ST4: per category across domains."""
    long = S.to_long(merged(spark, sf_dir), ["project", "domain"], CATEGORIES, "category", "value")
    out = S.kruskal_wallis(long, "category", "domain", "value")
    return out.select("category", _r6(F.col("h")).alias("h"), "df",
                      _r6(F.col("p_value")).alias("p_value"), "n")

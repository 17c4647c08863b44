"""Organization stores from departments and units, and reports put into a shared schema.

Everything is keyed by names and codes, never by numbers that are given out: a second run on its
own result changes nothing.  All steps are joins; no row comes to the driver.

departments(id, code, name, sort_order), units(id, department_id, code, name,
sort_order); documents(doc_id, organization_id, fiscal_year, doc_type, path, checksum).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import _kept

#: fixed values: ends of names that only departments have, and an end that takes it back
DEPARTMENT_ENDS, OWN_LEVEL = ("局", "人民政府办公室", "街道办事处", "镇人民政府", "委员会", "总工会", "人民法院", "人民检察院"), "本级"
#: fixed values: parts of names that say nothing of which organization it is, in this order
COMMON_PARTS = ("上海市普陀区", "上海市", "普陀区", "上海", "人民政府", "中国共产党", "中共")
#: fixed values: report types by the words of documents
FINAL_TYPES = ("final", "决算", "js", "settlement")


def plain_name(name: Column) -> Column:
    """A name without years, words of documents and marks."""
    t = F.trim(F.coalesce(name, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"20\d{2}(?:年度|年)?", ""), r"\d{2}(?:年度|年)", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)预算|决算|报告|公开|年度|pdf", ""), r"(?U)[\s（）()【】\[\]<>《》·,，、.\-_/]+", "")


def department_like(name: Column) -> Column:
    t = F.trim(F.coalesce(name, F.lit("")))
    ends = F.lit(False)
    for e in DEPARTMENT_ENDS:
        ends = ends | F.endswith(t, F.lit(e))
    return ends & ~F.endswith(t, F.lit(OWN_LEVEL))


def related(a: Column, b: Column) -> Column:
    """Whether one name holds the other, as they are or without common parts."""
    a, b = plain_name(a), plain_name(b)

    def core(x: Column) -> Column:
        for part in COMMON_PARTS:
            x = F.replace(x, F.lit(part), F.lit(""))
        return x

    held = lambda x, y: x.contains(y) | y.contains(x)
    both = (a != "") & (b != "")
    return both & (held(a, b) | ((core(a) != "") & (core(b) != "") & held(core(a), core(b))))


def promoted(unit: Column, parent: Column) -> Column:
    """Whether a unit counts as a department: it has the name of one, and its parent's (NULL: none) is unrelated."""
    return department_like(unit) & (parent.isNull() | ~related(unit, parent))


def organization_id(name: Column, level: str, parent: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(level), F.coalesce(parent, F.lit("root")), name)), 1, 12)


def organization_store(departments: DataFrame, units: DataFrame, city: str = "", district: str = "") -> DataFrame:
    """orgs(id, name, level, parent_id, code): the tree of city, district, departments and units.

    Units whose department is unknown go, promoted ones hang below a department of their own
    name (which is made where there is none).  Of organizations with the same name below the
    same parent the first in sort order stays.
    """
    spark = departments.sparkSession
    none = F.lit(None).cast("string")
    tops, root = [], none
    for name, level in ((city.strip(), "city"), (district.strip(), "district")):
        if name:
            own = organization_id(F.lit(name), level, root)
            tops.append(spark.range(1).select(own.alias("id"), F.lit(name).alias("name"), F.lit(level).alias("level"), root.alias("parent_id"), none.alias("code")))
            root = own
    first = Window.partitionBy("id").orderBy("k", "sort_order", "name", "source")
    depts = departments.select(F.col("id").alias("source"), "name", "code", "sort_order")
    below = units.select(F.col("id").alias("unit"), F.col("department_id").alias("source"), F.col("name").alias("unit_name"), F.col("code").alias("unit_code"), F.col("sort_order").alias("unit_order"))
    below = below.join(depts.select("source", F.col("name").alias("dept_name")).dropDuplicates(["source"]), "source")
    below = below.withColumn("own", promoted(F.col("unit_name"), F.col("dept_name"))).withColumn("above", F.when(F.col("own"), F.col("unit_name")).otherwise(F.col("dept_name")))
    made = below.where("own").select(F.col("unit").alias("source"), F.col("unit_name").alias("name"), none.alias("code"), F.col("unit_order").alias("sort_order"), F.lit(1).alias("k"))
    named = depts.withColumn("k", F.lit(0)).unionByName(made).withColumn("id", organization_id(F.col("name"), "department", root))
    named = named.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "name", F.lit("department").alias("level"), root.alias("parent_id"), "code")
    parent = organization_id(F.col("above"), "department", root)
    leaves = below.select(organization_id(F.col("unit_name"), "unit", parent).alias("id"), F.col("unit_name").alias("name"), parent.alias("parent_id"), F.col("unit_code").alias("code"), F.col("unit_order").alias("sort_order"), F.col("unit").alias("source"), F.lit(0).alias("k"))
    leaves = leaves.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "name", F.lit("unit").alias("level"), "parent_id", "code")
    out = named.unionByName(leaves)
    for t in tops:
        out = out.unionByName(t)
    return out


# ------------------------------------------------------------------ shared schema


@dataclass(frozen=True)
class Schema:
    """departments(code, name), units(department_code, code, name), reports(department_code,
    unit_code, year, report_type, path, checksum), items(department_code, unit_code, year,
    report_type, ...)."""

    departments: DataFrame
    units: DataFrame
    reports: DataFrame
    items: DataFrame


def auto_code(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.upper(F.substring(F.sha1(name), 1, 16)))


def scopes(documents: DataFrame, orgs: DataFrame) -> DataFrame:
    """documents plus department_name, department_code, unit_name, unit_code: of its organization
    and what that hangs below.  A department is a unit of its own; documents without either go."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("o_name"), F.col("level").alias("o_level"), text(F.col("code")).alias("o_code"), F.col("parent_id").alias("p_id"))
    above = orgs.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"), text(F.col("code")).alias("p_code"))
    # names are compared once for each organization, not for each of its documents
    rows = own.join(above, "p_id", "left").withColumn("up", promoted(F.col("o_name"), F.col("p_name")))
    is_unit, up = F.col("o_level") == "unit", F.col("up")
    rows = rows.where((F.col("o_level") == "department") | (is_unit & (up | F.col("p_name").isNotNull())))
    alone = F.when(F.col("o_code").isNotNull(), F.concat("o_code", F.lit("__SELF"))).otherwise(auto_code("AUTO_UNIT", F.col("o_name")))
    names = {
        "department_name": F.when(is_unit & ~up, F.col("p_name")).otherwise(F.col("o_name")),
        "department_code": F.when(~is_unit, F.col("o_code")).when(~up, F.col("p_code")),
        "unit_name": F.col("o_name"),
        "unit_code": F.when(is_unit, F.col("o_code")).otherwise(alone),
    }
    found = rows.select("organization_id", *[c.alias(n) for n, c in names.items()])
    keep = [c for c in documents.columns if c not in names]
    return documents.select(*keep).join(found, "organization_id").select(*keep, *names)


def ensured(have: DataFrame, wanted: DataFrame, prefix: str, below: tuple[str, ...] = (), exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """have(*below, code, name) with what wanted(*below, name, preferred) asks for, and (*below, name,
    preferred, code): the code that each stands under.

    A preferred code that is there takes the name (and place).  Else the name's first code is taken up,
    an automatic one changed to the preferred one; `exact`: only an automatic one, or
    without a preference.  What is left is put in, under the preferred code or one made from
    the name.  Of several names for one code the last in order counts.
    """
    want = wanted.select(*below, "name", "preferred").distinct()
    codes = have.select(F.col("code").alias("preferred"), F.lit(True).alias("there")).distinct()
    named = have.groupBy(*below, "name").agg(F.min("code").alias("old"))
    rows = want.join(codes, "preferred", "left").join(named, [*below, "name"], "left")
    automatic = F.startswith("old", F.lit(f"{prefix}_"))
    reuse = F.col("old").isNotNull() & (F.col("preferred").isNull() | automatic | (F.col("old") == F.col("preferred")) if exact else F.lit(True))
    code = F.when(F.coalesce("there", F.lit(False)), F.col("preferred")).when(reuse & automatic & F.col("preferred").isNotNull(), F.col("preferred")).when(reuse, F.col("old")).otherwise(F.coalesce("preferred", auto_code(prefix, F.concat_ws("/", *below, "name") if below else F.col("name"))))
    rows = rows.select(*below, "name", "preferred", "old", code.alias("code"), (reuse & automatic & F.col("preferred").isNotNull() & ~F.coalesce("there", F.lit(False))).alias("moved"))
    rows = _kept(rows)
    # an automatic code that was changed leaves; a code holds its last name
    kept = have.select(*below, "code", "name").join(rows.where("moved").select(F.col("old").alias("code")).distinct(), "code", "left_anti").join(rows.select("code").distinct(), "code", "left_anti")
    # a name taken up by a code that is there renames it; otherwise the name is the same
    new = rows.groupBy("code").agg(F.max(F.struct("name", *below)).alias("v")).select(*[F.col("v")[c].alias(c) for c in below], "code", F.col("v.name").alias("name"))
    return _kept(kept.unionByName(new)), rows.select(*below, "name", "preferred", "code")


def synchronized(schema: Schema, documents: DataFrame, items: DataFrame, orgs: DataFrame) -> Schema:
    """schema with all documents' departments, units, reports and items(doc_id, ...).

    A report is its unit's of a year and type: the last document (by doc_id) of each counts, and its
    items replace those that the report had.
    """
    # what is used more than once is computed once; names and codes are settled for each organization
    # that has documents, which meet the result in one join
    scoped = _kept(scopes(documents.select("organization_id").distinct(), orgs))
    departments, of = ensured(schema.departments, scoped.select(F.col("department_name").alias("name"), F.col("department_code").alias("preferred")), "AUTO_DEPT")
    of = of.select(F.col("name").alias("department_name"), F.col("preferred").alias("department_code"), F.col("code").alias("d_code"))
    on = scoped["department_name"].eqNullSafe(of["department_name"]) & scoped["department_code"].eqNullSafe(of["department_code"])
    scoped = scoped.join(of, on).drop(of["department_name"]).drop(of["department_code"]).drop("department_code").withColumnRenamed("d_code", "department_code")
    scoped = _kept(scoped)
    units, at = ensured(schema.units, scoped.select("department_code", F.col("unit_name").alias("name"), F.col("unit_code").alias("preferred")), "AUTO_UNIT", ("department_code",), exact=True)
    at = at.select(F.col("department_code").alias("k_dept"), F.col("name").alias("k_name"), F.col("preferred").alias("k_code"), F.col("code").alias("u_code"))
    on = (scoped["department_code"] == at["k_dept"]) & (scoped["unit_name"] == at["k_name"]) & scoped["unit_code"].eqNullSafe(at["k_code"])
    kind = F.when(F.lower(F.trim("doc_type")).isin(*FINAL_TYPES), "FINAL").otherwise("BUDGET")
    placed = _kept(scoped.join(at, on).select("organization_id", F.col("department_code").alias("d_code"), "u_code"))
    rows = documents.join(placed, "organization_id").select("doc_id", F.col("d_code").alias("department_code"), F.col("u_code").alias("unit_code"), F.col("fiscal_year").alias("year"), kind.alias("report_type"), "path", "checksum")
    key = ["department_code", "unit_code", "year", "report_type"]
    last = _kept(rows.groupBy(*key).agg(F.max(F.struct("doc_id", "path", "checksum")).alias("r")).select(*key, "r.*"))
    reports = schema.reports.join(last.select(*key), key, "left_anti").unionByName(last.drop("doc_id"))
    fresh = items.join(last.select("doc_id", *key), "doc_id").drop("doc_id")
    return Schema(departments, units, _kept(reports), _kept(schema.items.join(last.select(*key), key, "left_anti").unionByName(fresh)))

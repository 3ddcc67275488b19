"""Queries over changes and kept tables: transactions, batched writes, tagged and nested values, merged graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph, mutations
from sparkloom.plans.registry import register
from sparkloom.plans.store_queries import _G, _NODES, _records
from sparkloom.session import read_table, temporary_path
from sparkloom.sources import batch_store
from sparkloom.streaming import cdc

# Transactions: an order is a request over the parts of its lines.

_ITEMS = """(SELECT l_orderkey AS r, l_partkey AS k, CASE l_returnflag WHEN 'R' THEN 'check' WHEN 'A' THEN 'update' ELSE 'delete' END AS op, l_linenumber AS line,
    CASE l_returnflag WHEN 'A' THEN p_size > 2 END AS holds, p_partkey IS NOT NULL AS there, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
_JUDGED = f"""(SELECT r, min(CASE WHEN times > 1 THEN 'key named twice' WHEN NOT there THEN 'no such row' WHEN NOT holds THEN 'condition fails' WHEN f < r THEN 'conflict' END) AS reason
    FROM (SELECT i.*, count(*) OVER (PARTITION BY r, k) AS times, min(CASE WHEN op <> 'check' THEN r END) OVER (PARTITION BY k) AS f FROM {_ITEMS} i) GROUP BY r)"""


def _transacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    flag = F.col("l_returnflag")
    op = F.when(flag == "R", "check").when(flag == "A", "update").otherwise("delete")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("p_partkey"), op.alias("op"))
    judged = lines.join(part.select("p_partkey", F.col("p_size").alias("size")), "p_partkey", "left")
    update = F.col("op") == "update"
    items = judged.select(
        "request_id", "p_partkey", "op", F.lit("exists").alias("expects"), F.when(update, F.col("size") > 2).alias("holds"),
        F.lit(None).cast("string").alias("p_name"), F.when(update, F.col("size") - 1).cast(part.schema["p_size"].dataType).alias("p_size"),
    )
    return mutations.transacted(part, items, "p_partkey")


@register(f"SELECT r AS request_id, reason IS NULL AS accepted, reason FROM {_JUDGED}")
def transaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders take effect as a whole, and why the others don't at all."""
    return _transacted(spark, sf_dir)[1]


@register(
    f"""WITH w AS (SELECT k, op FROM {_ITEMS} i WHERE op <> 'check' AND r IN (SELECT r FROM {_JUDGED} WHERE reason IS NULL))
    SELECT p_partkey, p_name, CASE op WHEN 'update' THEN p_size - 1 ELSE p_size END AS p_size FROM part LEFT JOIN w ON k = p_partkey WHERE op IS NULL OR op <> 'delete'"""
)
def transacted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts after one commit of all accepted orders."""
    return _transacted(spark, sf_dir)[0]


@register("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name, p_size FROM part WHERE p_size <= 25")
def batched_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put into a keyed store in batches of 25, the large ones deleted in batches, and what is read back."""
    path = temporary_path(spark, "store")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    batch_store.write(part, path, "p_partkey", 1)
    batch_store.write(part.where("p_size > 25").select("p_partkey", F.lit(True).alias("__delete")), path, "p_partkey", 2)
    item = F.from_json("item", "p_name string, p_size long")
    return batch_store.read(spark, path).select("key", item["p_name"].alias("p_name"), item["p_size"].alias("p_size"))


@register("""SELECT p_partkey, '{"name":"' || p_name || '","parts":[' || p_size || ',{"brand":"' || p_brand || '"},true,null],"tags":["a","b"]}' AS value FROM part""")
def nested_wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps in lists in maps, with their tags, as plain JSON."""
    tagged = F.concat(
        F.lit('{"M":{"tags":{"SS":["b","a","b"]},"name":{"S":"'), "p_name", F.lit('"},"parts":{"L":[{"N":"'), F.col("p_size").cast("string"),
        F.lit('"},{"M":{"brand":{"S":"'), "p_brand", F.lit('"}}},{"BOOL":true},{"NULL":true}]}}}'),
    )
    return read_table(spark, sf_dir, "part").select("p_partkey", cdc.nested_value(tagged, 3).alias("value"))


# Studies in the registry's own JSON.


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study for each supplier, of sections that are there, absent (every fifth) or of another shape (every seventh)."""
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read_table(spark, sf_dir, "supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    some = lambda c: F.when(k % 5 > 0, c)
    protocol = F.struct(
        F.struct(F.concat(F.lit("N"), k).alias("nctId"), F.col("s_name").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.struct(F.lit("2024-01").alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.array(F.lit("PHASE1"), F.lit("PHASE2")).alias("phases"), F.struct((k * 10).alias("count")).alias("enrollmentInfo")).alias("designModule"),
        some(F.struct(F.array("n_name", F.lit("other")).alias("conditions"))).alias("conditionsModule"),
        F.struct(F.array(F.struct(F.concat(F.lit("drug "), "n_name").alias("interventionName"), F.lit("DRUG").alias("interventionType"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.struct(F.col("r_name").alias("name")).alias("leadSponsor"), F.array(F.struct(F.col("n_name").alias("name")), F.struct(F.lit("").alias("name"))).alias("collaborators")).alias("sponsorCollaboratorsModule"),
        F.struct(F.array(F.struct(F.concat(F.lit("site "), "n_name").alias("facility"), F.col("r_name").alias("country"), F.struct(F.lit(1.5).alias("lat")).alias("geoPoint"))).alias("locations")).alias("contactsLocationsModule"),
        F.struct(F.array(F.struct(F.lit("m").alias("measure"), F.lit("t").alias("timeFrame")), F.struct(F.lit("m2").alias("measure"), F.lit(None).cast("string").alias("timeFrame"))).alias("primaryOutcomes")).alias("outcomesModule"),
        F.struct(F.lit("ALL").alias("sex"), F.array(F.lit("ADULT")).alias("stdAges"), (k % 2 == 0).alias("healthyVolunteers")).alias("eligibilityModule"),
    )
    derived = F.struct(F.struct(F.array(F.struct(F.col("n_name").alias("term"), F.lit(2).alias("id")), F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("id"))).alias("meshes")).alias("conditionBrowseModule"), F.struct(F.array(F.struct(F.lit("agents").alias("term"))).alias("meshes")).alias("interventionBrowseModule"))
    whole = F.to_json(F.struct(protocol.alias("protocolSection"), derived.alias("derivedSection")))
    odd = F.concat(F.lit('{"protocolSection":{"identificationModule":{"nctId":"N'), k, F.lit('"},"conditionsModule":7,"outcomesModule":{"primaryOutcomes":"none"}},"derivedSection":[]}'))
    return rows.select(F.when(k % 7 == 0, odd).otherwise(whole).alias("json")).unionByName(spark.createDataFrame([("no json",)], "json string"))


_STUDIES = "(SELECT s_suppkey AS k, s_name, n_name, r_name, s_suppkey % 7 > 0 AS whole FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@register(
    f"""SELECT 'N' || k AS nct_id, CASE WHEN whole THEN s_name END AS title, CASE WHEN whole THEN 'PHASE1, PHASE2' ELSE '' END AS phase, CASE WHEN whole THEN k * 10 END AS enrollment, CASE WHEN whole AND k % 5 > 0 THEN n_name || ',other' ELSE '' END AS conditions,
    CASE WHEN whole THEN 'drug ' || n_name ELSE '' END AS drugs, CASE WHEN whole THEN r_name END AS sponsor, CASE WHEN whole THEN n_name ELSE '' END AS collaborators, CASE WHEN whole THEN 'site ' || n_name || ' ' || r_name || ' 1.5' ELSE '' END AS places,
    CASE WHEN whole THEN 'm t,m2 ' ELSE '' END AS outcomes, CASE WHEN whole THEN 'ALL' END AS gender, CASE WHEN whole THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS volunteers, CASE WHEN whole THEN n_name || ',agents' ELSE '' END AS mesh FROM {_STUDIES}"""
)
def trial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entity groups of each study, in writing."""
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return graph.parse_trials(_studies(spark, sf_dir)).select(
        F.col("trial.nctId").alias("nct_id"), F.col("trial.briefTitle").alias("title"), F.col("trial.phase").alias("phase"), F.col("trial.enrollmentCount").alias("enrollment"), F.array_join("conditions", ",").alias("conditions"),
        joined("interventions", lambda x: x["name"]).alias("drugs"), F.col("lead_sponsor").alias("sponsor"), F.array_join("collaborators", ",").alias("collaborators"),
        joined("locations", lambda x: F.concat_ws(" ", x["facility"], x["country"], x["lat"])).alias("places"), joined(F.concat("primary_outcomes", "secondary_outcomes"), lambda x: F.concat_ws(" ", x["measure"], x["timeFrame"])).alias("outcomes"),
        F.col("patient_population.gender").alias("gender"), F.col("patient_population.healthyVolunteers").alias("volunteers"), F.array_join("mesh_terms", ",").alias("mesh"),
    )


# Kept graphs.


@register(f"SELECT o AS batches, label, key FROM {_NODES}, (VALUES ('ab'), ('ba')) t(o)")
def graph_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a kept graph after two batches of studies, merged in either order, one of them twice."""
    records = _records(spark, sf_dir)
    a, b = (records.where(F.crc32(F.col("id").cast("binary")) % 2 == n) for n in (0, 1))
    out = None
    for name, parts in (("ab", (a, b)), ("ba", (b, a, a))):
        kept = graph.KeptGraph(spark, temporary_path(spark, "graph"), 8)
        for part in parts:
            kept.merge(graph.nodes(part), graph.edges(part))
        found = kept.nodes().select(F.lit(name).alias("batches"), "label", "key")
        out = found if out is None else out.unionByName(found)
    return out


@register(f"SELECT id AS trial, 'site ' || n_name AS site, r_name AS country FROM {_G} WHERE k % 2 = 0")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial:Trial)-[LOCATED_AT]->(site:Site)-[IN_COUNTRY]->(country:Country) with the trial conducted in that country."""
    records = _records(spark, sf_dir)
    nodes, edges = graph.nodes(records), graph.edges(records)
    steps = (("LOCATED_AT", ">", "site", "Site"), ("IN_COUNTRY", ">", "country", "Country"), ("CONDUCTED_IN", "<", "trial", "Trial"))
    return graph.match(nodes, edges, ("trial", "Trial"), *steps)

"""A knowledge graph from nested study records: nodes(label, key, props) and edges(src, rel, dst) tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import written

RECORD = (
    "id string, title string, conditions array<string>, drugs array<struct<name:string,type:string>>, sponsor struct<name:string,class:string>, cros array<string>, "
    "sites array<struct<name:string,city:string,country:string>>, outcomes array<struct<measure:string,time_frame:string>>, population struct<sex:string,minimum_age:string>, mesh array<string>"
)


def dig(json: Column, path: str, default: str | None = None) -> Column:
    """A nested value by its path, or the default."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(default))


def parse_records(raw: DataFrame) -> DataFrame:
    """raw(json): typed records; unreadable ones are left out."""
    return raw.select(F.from_json("json", RECORD).alias("r")).where("r.id is not null").select("r.*")


#: Where a study's entities lie in the JSON of the registry's interface.
SECTIONS = {
    "ident": "protocolSection.identificationModule", "status": "protocolSection.statusModule", "design": "protocolSection.designModule", "arms": "protocolSection.armsInterventionsModule",
    "sponsor": "protocolSection.sponsorCollaboratorsModule", "population": "protocolSection.eligibilityModule", "places": "protocolSection.contactsLocationsModule",
    "outcomes": "protocolSection.outcomesModule", "conditions": "protocolSection.conditionsModule", "conditionMesh": "derivedSection.conditionBrowseModule", "interventionMesh": "derivedSection.interventionBrowseModule",
}


def parse_trials(raw: DataFrame, json: str = "json") -> DataFrame:
    """The ten entity groups of studies as the registry gives them, by paths into a VARIANT, so that fields of any other shape,
    or none at all, do no harm: trial, conditions, interventions, lead_sponsor, collaborators, locations, primary_outcomes,
    secondary_outcomes, patient_population, mesh_terms. What is no JSON object gives no row; lists that are absent are
    empty; entries without a name are left out of collaborators and terms."""
    v = raw.select(F.try_parse_json(json).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))

    def at(section: str, path: str, kind: str = "string") -> Column:
        return F.try_variant_get("v", f"$.{SECTIONS[section]}.{path}", kind)

    def many(section: str, path: str, each, kind: str) -> Column:
        return F.coalesce(F.transform(at(section, path, "array<variant>"), each), F.array().cast(f"array<{kind}>"))

    def fields(**paths: str):
        return lambda x: F.struct(*[F.try_variant_get(x, f"$.{p}", "string").alias(n) for n, p in paths.items()])

    named = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    text = lambda path: lambda x: F.try_variant_get(x, f"$.{path}", "string")
    plain = lambda x: x.cast("string")
    empty = lambda x, *keys: F.struct(*[(F.coalesce(x[k], F.lit("")) if k in keys else x[k]).alias(k) for k in ("measure", "description", "timeFrame")])
    outcome = lambda kind: lambda x: F.struct(empty(fields(measure="measure", description="description", timeFrame="timeFrame")(x), "description", "timeFrame").alias("o"), F.lit(kind).alias("type"))
    flat = lambda c: F.transform(c, lambda x: F.struct(x["o"]["measure"].alias("measure"), x["o"]["description"].alias("description"), x["o"]["timeFrame"].alias("timeFrame"), x["type"].alias("type")))
    outcomes = "struct<o:struct<measure:string,description:string,timeFrame:string>,type:string>"
    dates = {"startDate": "startDateStruct.date", "primaryCompletionDate": "primaryCompletionDateStruct.date", "completionDate": "completionDateStruct.date"}
    trial = F.struct(
        *[at("ident", c).alias(c) for c in ("nctId", "briefTitle", "officialTitle", "acronym")], at("status", "overallStatus").alias("overallStatus"), *[at("status", p).alias(c) for c, p in dates.items()],
        *[at("status", c).alias(c) for c in ("studyFirstSubmitDate", "lastUpdateSubmitDate", "statusVerifiedDate")], F.array_join(many("design", "phases", plain, "string"), ", ").alias("phase"),
        at("design", "enrollmentInfo.count", "long").alias("enrollmentCount"), at("design", "enrollmentInfo.type").alias("enrollmentType"),
    )
    people = F.struct(
        at("population", "eligibilityCriteria").alias("eligibilityCriteria"), at("population", "sex").alias("gender"), at("population", "minimumAge").alias("minimumAge"), at("population", "maximumAge").alias("maximumAge"),
        many("population", "stdAges", plain, "string").alias("stdAges"), F.coalesce(at("population", "healthyVolunteers"), F.lit("")).alias("healthyVolunteers"),
    )
    place = fields(facility="facility", city="city", country="country", zip="zip", lat="geoPoint.lat", lon="geoPoint.lon")
    return v.select(
        trial.alias("trial"), many("conditions", "conditions", plain, "string").alias("conditions"), many("arms", "interventions", fields(name="interventionName", type="interventionType"), "struct<name:string,type:string>").alias("interventions"),
        at("sponsor", "leadSponsor.name").alias("lead_sponsor"), named(many("sponsor", "collaborators", text("name"), "string")).alias("collaborators"),
        many("places", "locations", place, "struct<facility:string,city:string,country:string,zip:string,lat:string,lon:string>").alias("locations"),
        flat(many("outcomes", "primaryOutcomes", outcome("primary"), outcomes)).alias("primary_outcomes"), flat(many("outcomes", "secondaryOutcomes", outcome("secondary"), outcomes)).alias("secondary_outcomes"),
        people.alias("patient_population"), named(F.concat(many("conditionMesh", "meshes", text("term"), "string"), many("interventionMesh", "meshes", text("term"), "string"))).alias("mesh_terms"),
    )


def trial_records(trials: DataFrame) -> DataFrame:
    """parse_trials() as records for nodes() and edges(); a study without an id is left out."""
    outcomes = F.transform(F.concat("primary_outcomes", "secondary_outcomes"), lambda o: F.struct(o["measure"].alias("measure"), o["timeFrame"].alias("time_frame")))
    return trials.where("trial.nctId is not null").select(
        F.col("trial.nctId").alias("id"), F.col("trial.briefTitle").alias("title"), "conditions", F.col("interventions").alias("drugs"), F.struct(F.col("lead_sponsor").alias("name"), F.lit(None).cast("string").alias("class")).alias("sponsor"),
        F.col("collaborators").alias("cros"), F.transform("locations", lambda x: F.struct(x["facility"].alias("name"), x["city"].alias("city"), x["country"].alias("country"))).alias("sites"), outcomes.alias("outcomes"),
        F.struct(F.col("patient_population.gender").alias("sex"), F.col("patient_population.minimumAge").alias("minimum_age")).alias("population"), F.col("mesh_terms").alias("mesh"),
    )


def _name(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _node(rows: DataFrame, label: str, key: Column, *props: tuple[str, Column]) -> DataFrame:
    pairs = [x for k, v in props for x in (F.lit(k), v.cast("string"))]
    attributes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(label).alias("label"), key.alias("key"), attributes.alias("props")).where("key is not null")


def nodes(records: DataFrame) -> DataFrame:
    """One node for each label and key (the record with the largest id sets the properties); outcomes and populations are
    created for each record, never shared."""
    each = lambda c: records.select("id", F.explode(c).alias("x"))
    shared = [
        _node(records, "Trial", _name(F.col("id")), ("title", F.col("title"))),
        _node(records, "TrialCategory", F.coalesce(_name(F.get("conditions", F.lit(0))), F.lit("Unknown"))),
        _node(each("conditions"), "Disease", _name(F.col("x"))),
        _node(each("drugs"), "Drug", _name(F.col("x.name")), ("type", F.col("x.type"))),
        _node(records, "Sponsor", _name(F.col("sponsor.name")), ("class", F.col("sponsor.class"))),
        _node(each("cros"), "CRO", _name(F.col("x"))),
        _node(each("sites"), "Site", _name(F.col("x.name")), ("city", F.col("x.city"))),
        _node(each("sites"), "Country", _name(F.col("x.country"))),
        _node(each("mesh"), "MeSHTerm", _name(F.col("x"))),
    ]
    merged = shared[0]
    for s in shared[1:]:
        merged = merged.unionByName(s)
    once = merged.groupBy("label", "key").agg(F.max_by("props", F.to_json("props")).alias("props"))
    outcomes = records.select("id", F.posexplode("outcomes").alias("n", "x"))
    own = _node(outcomes, "Outcome", F.concat_ws("#", "id", (F.col("n") + 1).cast("string")), ("measure", F.col("x.measure")), ("time_frame", F.col("x.time_frame")))
    people = _node(records.where("population is not null"), "PatientPopulation", F.concat("id", F.lit("#population")), ("sex", F.col("population.sex")), ("minimum_age", F.col("population.minimum_age")))
    return once.unionByName(own).unionByName(people)


def edges(records: DataFrame) -> DataFrame:
    """Distinct relations; a site is linked only where its country is known."""
    each = lambda c: records.select("id", F.explode(c).alias("x"))
    link = lambda rows, rel, dst, src=F.col("id"): rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst")).where("src is not null and dst is not null")
    sites = each("sites").where(_name(F.col("x.country")).isNotNull())
    parts = [
        link(records, "BELONGS_TO", F.coalesce(_name(F.get("conditions", F.lit(0))), F.lit("Unknown"))), link(each("conditions"), "TARGETS", _name(F.col("x"))), link(each("drugs"), "USES", _name(F.col("x.name"))),
        link(records, "SPONSORED_BY", _name(F.col("sponsor.name"))), link(each("cros"), "MANAGED_BY", _name(F.col("x"))), link(sites, "CONDUCTED_IN", _name(F.col("x.country"))),
        link(sites, "LOCATED_AT", _name(F.col("x.name"))), link(sites, "IN_COUNTRY", _name(F.col("x.country")), _name(F.col("x.name"))),
        link(records.select("id", F.posexplode("outcomes").alias("n", "x")), "MEASURES", F.concat_ws("#", "id", (F.col("n") + 1).cast("string"))),
        link(records.where("population is not null"), "INCLUDES", F.concat("id", F.lit("#population"))), link(each("mesh"), "ASSOCIATED_WITH", _name(F.col("x"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def label_counts(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.groupBy("label").agg(F.count("*").alias("n"))


def duplicate_keys(all_nodes: DataFrame) -> DataFrame:
    """What a uniqueness constraint would refuse."""
    return all_nodes.groupBy("label", "key").count().where("count > 1")


def reached(roots: DataFrame, table: DataFrame, key: str, parent: str, level: str, most: int = 1000) -> DataFrame:
    """roots(key, parent, level) and all rows of table(key, parent) below them, with their level: a join a level, each level
    written, until one is empty. A chain deeper than ``most`` is an error, as a cycle would never end."""
    out = now = written(roots, "level")
    for _ in range(most):
        above = now.select(F.col(key).alias(parent), (F.col(level) + 1).alias(level))
        now = written(table.join(above, parent).select(key, parent, level), "level")
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise ValueError(f"deeper than {most} levels: is there a cycle?")


#: Partitions of a kept graph.
BUCKETS = 64
NODE, EDGE = "label string, key string, props map<string,string>", "src string, rel string, dst string"


class KeptGraph:
    """Node and edge tables under a path, merged with what comes, batch by batch; only the partitions of the keys that come
    are read and written again.

    A merge is by key: of several properties of a node those last in the order of their JSON stay, and an edge is there once.
    So batches may come in any order, and be repeated: after a failure in the middle of a merge, repeat its batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was merged yet
            return self.spark.createDataFrame([], f"{schema}, bucket int")

    def nodes(self) -> DataFrame:
        return self._table("nodes", NODE).drop("bucket")

    def edges(self) -> DataFrame:
        return self._table("edges", EDGE).drop("bucket")

    def _merge(self, name: str, schema: str, rows: DataFrame, keys: list[str]) -> None:
        own = written(rows.select(*[c.split()[0] for c in schema.split(", ")], F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")), "merge")
        touched = [r[0] for r in own.select("bucket").distinct().collect()]  # at most as many as there are partitions
        if not touched:
            return
        both = self._table(name, schema).where(F.col("bucket").isin(touched)).unionByName(own)
        rest = [c for c in both.columns if c not in (*keys, "bucket")]
        best = [F.max_by(c, F.to_json(c)).alias(c) for c in rest]
        merged = both.groupBy(*keys, "bucket").agg(*best) if best else both.distinct()
        merged = written(merged.select(both.columns), "merged")  # what is read can't be overwritten
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def merge(self, new_nodes: DataFrame, new_edges: DataFrame) -> None:
        self._merge("nodes", NODE, new_nodes, ["label", "key"])
        self._merge("edges", EDGE, new_edges, ["src", "rel", "dst"])


def match(all_nodes: DataFrame, all_edges: DataFrame, start: tuple[str, str], *steps: tuple[str, str, str, str]) -> DataFrame:
    """The ways through a graph that fit a pattern. start is (name, label); a step is (relation, direction, name, label) with
    the direction ">" or "<". Gives the keys of the named nodes, a row for each way; a name that comes again must meet the
    same node. A step is a join with the edges of its relation and one with the nodes of its label."""
    name, label = start
    of = lambda label: all_nodes.where(F.col("label") == label)
    found, last = of(label).select(F.col("key").alias(name)), name
    for rel, direction, name, label in steps:
        near, far = ("src", "dst") if direction == ">" else ("dst", "src")
        known = name in found.columns
        hop = all_edges.where(F.col("rel") == rel).select(F.col(near).alias("__near"), F.col(far).alias("__far"))
        hop = hop.join(of(label).select(F.col("key").alias("__far")), "__far", "left_semi")
        found = found.join(hop, F.col(last) == F.col("__near")).drop("__near")
        found = found.where(F.col(name) == F.col("__far")).drop("__far") if known else found.withColumnRenamed("__far", name)
        last = name
    return found

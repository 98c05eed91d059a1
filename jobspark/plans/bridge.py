"""The given tables in the roles of the job-posting model.

documents are postings, pages an HTML feed, embeddings chunk vectors, customer users
and profiles, orders applications, lineitem interview notes, events user actions.
Every role covers its whole table. Times stay without zone, as in the tables.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text
from ..sources import feeds
from ..sources.tables import scan, spread

MODELS = ("model-0", "model-1")


def as_of(day: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{day} 00:00:00'")


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet", list(columns) or None)


def posting_id(number: Column) -> Column:
    """Id of the posting made from a document number."""
    return F.concat(F.lit("src"), (number % 20).cast("string"), F.lit(":"),
                    number.cast("string"))


def pick(value: Column, cases: dict, default=None) -> Column:
    out = F.lit(default)
    for key, result in reversed(list(cases.items())):
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(value == key, result).otherwise(out)
    return out


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents"), "doc_id")
    n = F.col("doc_id")
    web = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), n.cast("string"))
    return d.select(
        F.concat("source", F.lit(":"), n.cast("string")).alias("id"),
        "source", n.cast("string").alias("external_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.upper("source").alias("company"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("location"),
        pick(F.col("lang"), {"en": True, "es": F.lit(None).cast("boolean")}, False)
        .alias("remote"),
        (F.col("n_chars") * 5).cast("double").alias("salary_min"),
        F.when(n % 5 != 0, (F.col("n_chars") * 10).cast("double")).alias("salary_max"),
        F.lit("USD").alias("salary_currency"),
        F.when(n % 2 == 0, F.lit("full_time")).otherwise("contract").alias("employment_type"),
        F.col("lang").alias("category"), F.col("text").alias("description_text"),
        F.when(n % 7 == 0, F.lit(None))
        .when(n % 11 == 0, F.concat(F.lit("ftp://files.example.com/"), n.cast("string")))
        .when(n % 17 == 0, F.lit("https:///nohost")).otherwise(web).alias("apply_url"),
        F.when(n % 13 != 0, as_of("2024-01-01") + hours(n)).alias("posted_at"),
        F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("payload_json"),
        (as_of("2024-06-01") + hours(n % 24)).alias("synced_at"),
        n.alias("ingest_seq"),
    )


def resent_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting twice: as first landed, and landed again under another title."""
    first = raw_postings(spark, sf).withColumn("landing", F.lit(0))
    again = first.withColumn("title", F.concat(F.lit("re: "), "title")).withColumn(
        "landing", F.lit(1))
    return first.unionByName(again)


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """The state table: cleaned and hashed."""
    raw = raw_postings(spark, sf)
    return raw.withColumns({
        c: text.clean_space(c) for c in ("title", "company", "location", "description_text")
    }).withColumn("content_hash", text.content_hash("description_text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors: four chunks per posting, two models, some of an older text."""
    e = table(spark, sf, "embeddings")
    hashes = postings(spark, sf).select(
        F.col("id").alias("job_posting_id"), F.col("content_hash").alias("_hash"))
    owner = F.floor(F.col("vec_id") / 4).cast("long")
    rows = e.select(
        F.col("vec_id").cast("string").alias("id"),
        posting_id(owner).alias("job_posting_id"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
        "embedding",
        F.when(F.col("label") % 2 == 0, MODELS[0]).otherwise(MODELS[1]).alias("model_name"),
        "label",
    )
    return rows.join(hashes, "job_posting_id").select(
        "id", "job_posting_id", "chunk_index", "chunk_text", "embedding", "model_name",
        F.when(F.col("label") == 9, F.lit("outdated")).otherwise(F.col("_hash"))
        .alias("content_hash"),
        as_of("2024-06-02").alias("created_at"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One search per label: the mean vector of the label, each with its own filters."""
    e = table(spark, sf, "embeddings", "label", "embedding")
    mean = e.groupBy("label").agg(
        Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("m"))
    n = F.col("label")
    return mean.select(
        n.cast("string").alias("request_id"),
        vector_to_array("m").alias("vector"),
        F.when(n % 2 == 0, MODELS[0]).otherwise(MODELS[1]).alias("model_name"),
        F.when(n == 2, F.array(*[F.lit(f"SRC{i}") for i in range(10)])).alias("sources"),
        (n % 3 == 0).alias("remote_only"),
        F.when(n % 4 == 1, F.lit(10000.0)).alias("minimum_salary"),
        F.when(n == 5, F.lit("D")).when(n == 8, F.lit("_r")).alias("location"),
    )


def vector_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A search without filters for every stored vector whose number 50 divides."""
    e = table(spark, sf, "embeddings", "vec_id", "label", "embedding").filter("vec_id % 50 = 0")
    nothing = {"sources": "array<string>", "remote_only": "boolean", "minimum_salary": "double",
               "location": "string"}
    return e.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("request_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(F.col("label") % 2 == 0, MODELS[0]).otherwise(MODELS[1]).alias("model_name"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])


ROLES = {
    "HOUSEHOLD": ["The", "of"], "FURNITURE": ["und"], "MACHINERY": [],
    "BUILDING": ["la", "de"], "AUTOMOBILE": ["en_"],
}
PREFERENCES = {0: "remote_only", 1: "hybrid", 2: "onsite", 3: "any"}
PLACES = {0: ["EN"], 1: ["de", "fr"], 2: [" "]}
RESUMES = {
    "HOUSEHOLD": "The work of the house", "FURNITURE": "Holz und Leim und que",
    "MACHINERY": "Automation of the station", "BUILDING": "La casa de la playa",
}


def _texts(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer", "c_custkey", "c_name")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("display_name"),
        as_of("2023-01-01").alias("created_at"))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")
    return c.select(
        F.concat(F.lit("p"), key).alias("id"), key.alias("user_id"),
        F.lit("default").alias("label"),
        pick(segment, {k: _texts(v) for k, v in ROLES.items()}).alias("target_roles"),
        F.lower("c_mktsegment").alias("seniority"),
        F.col("c_acctbal").alias("salary_min"), F.lit("USD").alias("salary_currency"),
        pick(F.col("c_nationkey") % 4, PREFERENCES).alias("remote_preference"),
        pick(F.col("c_nationkey") % 3, {k: _texts(v) for k, v in PLACES.items()})
        .alias("locations_preferred"),
        _texts([]).alias("deal_breakers"),
        pick(segment, RESUMES).alias("resume_text"),
        F.when(segment != "AUTOMOBILE", F.concat("c_name", F.lit(".txt")))
        .alias("resume_filename"),
        F.lit(True).alias("is_default"),
        (as_of("2023-01-01") + hours(F.col("c_custkey"))).alias("created_at"),
        as_of("2023-06-01").alias("updated_at"),
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """A request by every customer whose number 50 divides; some have no account here."""
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").filter(
        "c_custkey % 50 = 0")
    n = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("q"), n.cast("string")).alias("request_id"),
        F.concat(F.upper("c_name"), F.when(n % 350 == 0, "@nowhere.example.com").otherwise(
            "@example.com ")).alias("user_email"),
        F.concat(F.lit("  work of\tthe "), F.lower("c_mktsegment")).alias("query"),
        (n % 200 == 0).alias("remote_only"),
        F.when(F.col("c_acctbal") > 2000, F.lit(2000.0)).alias("minimum_salary"),
        F.when(n % 150 == 0, F.lit("e")).alias("location"))


STAGE_OF = {
    "1-URGENT": "interviewing", "2-HIGH": "applied", "3-MEDIUM": "saved",
    "4-NOT SPECIFIED": "rejected", "5-LOW": "offer",
}


def documents(spark: SparkSession, sf: str) -> int:
    """Number of postings, which orders are spread over."""
    return max(1, table(spark, sf, "documents", "doc_id").count())


def applications(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("a"), key).alias("id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile_id"),
        posting_id(F.col("o_orderkey") % documents(spark, sf)).alias("job_posting_id"),
        pick(F.col("o_orderpriority"), STAGE_OF).alias("stage"),
        F.col("o_orderdate").alias("stage_updated_at"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderdate")).alias("applied_at"),
    )


def notes(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate")
    return i.select(
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("application_id"),
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.to_date("l_shipdate").alias("follow_up_date"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        posting_id(k).alias("job_posting_id"), "event_type", "value",
        "ts", F.col("event_id").alias("seq"))


def feedback_actions(spark: SparkSession, sf: str) -> DataFrame:
    kind = pick(F.col("event_type"), {"purchase": "good", "error": "bad", "view": "skip"})
    reason = F.when(F.col("value") > 20, F.col("value").cast("string"))
    return actions(spark, sf).select(
        "user_id", "job_posting_id", kind.alias("feedback"), reason.alias("reason"),
        "ts", "seq").filter(F.col("feedback").isNotNull())


def stage_actions(spark: SparkSession, sf: str) -> DataFrame:
    stage = pick(F.col("event_type"), {
        "click": "applied", "view": "interviewing", "error": "rejected",
        "purchase": "offer"})
    return actions(spark, sf).select(
        "user_id", "job_posting_id", stage.alias("stage"),
        F.when(F.col("value") > 10, F.concat(F.lit("p"), "user_id")).alias("profile_id"),
        "ts", "seq")


def bookmark_actions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("save")
    note = F.when(F.col("value") > 30, F.concat(F.lit("note "), F.col("seq").cast("string"))
                  ).when(F.col("value") > 20, F.lit(""))
    return actions(spark, sf).select(
        "user_id", "job_posting_id", kind.alias("action"), note.alias("note"), "ts", "seq")


def profile_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Several profiles per user, some created as default."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_default"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run log: one run per event."""
    e = table(spark, sf, "events", "event_id", "event_type", "ts", "value")
    status = F.when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "signup", "running").otherwise("completed")
    return e.select(
        F.col("event_id").cast("string").alias("id"), status.alias("status"),
        F.col("ts").alias("started_at"),
        F.when(status != "running", F.col("ts") + F.make_dt_interval(mins=F.lit(5)))
        .alias("finished_at"),
        F.floor("value").cast("int").alias("fetched_rows"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("event_id").cast("string")))
        .alias("error_message"))


def posting_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of the parts that the orders behind a posting contain."""
    i = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    return i.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        posting_id(F.col("l_orderkey") % documents(spark, sf)).alias("job_posting_id"),
        F.col("p_brand").alias("skill_id")).distinct()


def profile_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Brands a customer has ordered."""
    i = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return (
        i.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile_id"),
                F.col("p_brand").alias("skill_id")).distinct()
    )


def required_skills(spark: SparkSession, sf: str) -> DataFrame:
    pairs = applications(spark, sf).select("profile_id", "job_posting_id").distinct()
    return pairs.join(posting_skills(spark, sf), "job_posting_id").select(
        "profile_id", "skill_id")


def url_status(spark: SparkSession, sf: str) -> DataFrame:
    """What a separate check found for most of the addresses."""
    n = F.col("external_id").cast("long")
    return (
        raw_postings(spark, sf).select("apply_url", n.alias("n"))
        .filter(F.col("apply_url").isNotNull() & (F.col("n") % 9 != 0))
        .groupBy(F.col("apply_url").alias("url")).agg(
            F.min(pick(F.col("n") % 4, {1: 404, 2: 500}, 200)).alias("http_status"),
            F.max(F.col("n") % 19 == 0).alias("is_private"))
    )


# ---- raw feeds, as JSON text that is parsed with the feed schemas -------------------

def _created(n: Column) -> Column:
    day = F.date_format(F.expr("DATE'2024-01-01'") + (n % 28).cast("int"), "yyyy-MM-dd")
    return pick(n % 4, {
        0: F.concat(day, F.lit("T10:20:30Z")), 1: F.concat(day, F.lit("T10:20:30+05:00")),
        2: F.concat(day, F.lit("T10:20:30.250"))}, "soon")


def feed_a(spark: SparkSession, sf: str) -> DataFrame:
    d, n = spread(table(spark, sf, "documents"), "doc_id"), F.col("doc_id")
    result = F.struct(
        n.cast("string").alias("id"),
        F.when(n % 50 != 49, F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("description"),
        F.struct(F.when(n % 3 == 0, F.lit("Remote, DE")).otherwise(F.col("lang"))
                 .alias("display_name")).alias("location"),
        F.struct(F.col("source").alias("display_name")).alias("company"),
        F.struct(F.col("lang").alias("label")).alias("category"),
        pick(n % 3, {0: "full_time", 1: ""}).alias("contract_time"),
        F.lit("permanent").alias("contract_type"),
        F.col("n_chars").cast("double").alias("salary_min"),
        (F.col("n_chars") * 2).cast("double").alias("salary_max"),
        F.concat(F.lit("https://a.example.com/"), n.cast("string")).alias("redirect_url"),
        _created(n).alias("created"))
    page = d.select(
        n.alias("ingest_seq"), F.to_json(F.struct(F.array(result).alias("results"))).alias("j"))
    parsed = F.from_json("j", schemas.SOURCE_A)
    return page.select("ingest_seq", F.explode(parsed["results"]).alias("raw"))


def feed_b(spark: SparkSession, sf: str) -> DataFrame:
    d, n = spread(table(spark, sf, "documents"), "doc_id"), F.col("doc_id")
    descriptor = F.struct(
        F.substring_index("text", "\n", 1).alias("PositionTitle"),
        F.when(n % 4 != 0, F.col("text")).alias("QualificationSummary"),
        F.when(n % 3 != 0, F.lit("")).otherwise(F.col("source")).alias("OrganizationName"),
        F.lit("Department").alias("DepartmentName"),
        F.col("lang").alias("PositionLocationDisplay"),
        F.concat(F.lit("https://b.example.com/"), n.cast("string")).alias("PositionURI"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("https://apply.example.com/"),
                                            n.cast("string")))).otherwise(
            F.array().cast("array<string>")).alias("ApplyURI"),
        _created(n).alias("PublicationStartDate"),
        F.when(n % 5 != 0, F.array(F.struct(
            F.when(n % 7 == 0, F.lit("unknown")).otherwise(
                F.col("n_chars").cast("string")).alias("MinimumRange"),
            F.concat((F.col("n_chars") * 3).cast("string"), F.lit(".5")).alias("MaximumRange"),
        ))).alias("PositionRemuneration"),
        F.array(F.struct(F.lit("Full-time").alias("Name"))).alias("PositionSchedule"),
        F.array(F.struct(F.col("lang").alias("Name")),
                F.struct(F.lit("second").alias("Name"))).alias("JobCategory"),
        F.struct(F.struct(
            F.when(n % 6 == 0, F.concat(F.lit("  Summary \t of "), "source"))
            .alias("JobSummary"),
            F.when(n % 8 == 0, F.lit("")).otherwise("duties").alias("MajorDuties"),
        ).alias("Details")).alias("UserArea"))
    item = F.struct(n.cast("string").alias("MatchedObjectId"),
                    descriptor.alias("MatchedObjectDescriptor"))
    page = d.select(n.alias("ingest_seq"), F.to_json(F.struct(F.struct(
        F.array(item).alias("SearchResultItems")).alias("SearchResult"))).alias("j"))
    parsed = F.from_json("j", schemas.SOURCE_B)
    return page.select(
        "ingest_seq", F.explode(parsed["SearchResult"]["SearchResultItems"]).alias("raw"))


def feed_c(spark: SparkSession, sf: str) -> DataFrame:
    """The web pages, as descriptions of an HTML feed."""
    p, n = spread(table(spark, sf, "pages"), "page_id"), F.col("page_id")
    listing = F.struct(
        n.cast("string").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("position"),
        F.regexp_extract("url", "//([^/]+)/", 1).alias("company"),
        F.when(n % 2 == 0, F.lit("")).otherwise("Berlin").alias("location"),
        F.when(n % 4 == 0, F.regexp_replace(
            "html", "</article>",
            "<p>Please mention the word <b>x</b> &amp; tag it.</p></article>"))
        .otherwise(F.col("html")).alias("description"),
        F.array(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).alias("tags"),
        F.when(n % 3 == 0, (n * 3600 + 1700000000).cast("double")).otherwise(0.0)
        .alias("epoch"),
        _created(n).alias("date"),
        F.when(n % 2 == 0, 0.0).otherwise(50000.0).alias("salary_min"),
        F.lit(90000.0).alias("salary_max"),
        F.when(n % 5 == 0, F.lit("")).otherwise(
            F.concat(F.col("url"), F.lit("?apply"))).alias("apply_url"),
        F.col("url").alias("url"))
    page = p.select(n.alias("ingest_seq"), F.to_json(listing).alias("j"))
    raw = F.from_json("j", schemas.SOURCE_C)
    return page.select("ingest_seq", raw.alias("raw")).filter(
        feeds.real_id(F.col("raw.id")))

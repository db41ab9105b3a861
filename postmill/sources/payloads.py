"""Readers of landed job-board answers: one row shape out of many payload shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.web import first_field

POSTING = ("company", "title", "location", "url", "source", "posted", "salary_min", "salary_max", "currency", "salary_text")


def _text(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _joined(v: str, *paths: str) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


#: Where each board's answer holds its list, and each field of an element.
SHAPES: dict[str, tuple[str, dict[str, str | tuple[str, ...]]]] = {
    "greenhouse": ("$.jobs", {"title": "$.title", "location": "$.location.name", "url": "$.absolute_url", "posted": "$.updated_at"}),
    "lever": ("$", {"title": "$.text", "location": "$.categories.location", "url": "$.hostedUrl", "posted": "$.createdAt"}),
    "ashby": ("$.jobs", {"title": "$.title", "location": "$.location", "url": "$.jobUrl", "posted": "$.publishedAt", "salary_text": "$.compensation.compensationTierSummary"}),
    "smartrecruiters": ("$.content", {"title": "$.name", "location": "$.location.city", "posted": "$.releasedDate"}),
    "workable": ("$.jobs", {"title": "$.title", "location": ("$.city", "$.country"), "url": "$.url", "posted": "$.published_on"}),
    "breezy": ("$", {"title": "$.name", "location": "$.location.name", "url": "$.url", "posted": "$.published_date"}),
    "bamboohr": ("$.result", {"title": "$.jobOpeningName", "location": ("$.location.city", "$.location.state"), "posted": "$.datePosted"}),
    "recruitee": ("$.offers", {"title": "$.title", "location": "$.location", "url": "$.careers_url", "posted": "$.published_at"}),
    "eightfold": ("$.positions", {"title": "$.name", "location": "$.location", "url": "$.canonicalPositionUrl", "posted": "$.t_create"}),
    "workday": ("$.jobPostings", {"title": "$.title", "location": "$.locationsText", "url": "$.externalPath", "posted": "$.postedOn"}),
    "adzuna": ("$.results", {"company": "$.company.display_name", "title": "$.title", "location": "$.location.display_name", "url": "$.redirect_url", "posted": "$.created", "salary_min": "$.salary_min", "salary_max": "$.salary_max"}),
    "reed": ("$.results", {"company": "$.employerName", "title": "$.jobTitle", "location": "$.locationName", "url": "$.jobUrl", "posted": "$.date", "salary_min": "$.minimumSalary", "salary_max": "$.maximumSalary"}),
    "jooble": ("$.jobs", {"company": "$.company", "title": "$.title", "location": "$.location", "url": "$.link", "posted": "$.updated", "salary_text": "$.salary"}),
    "careerjet": ("$.jobs", {"company": "$.company", "title": "$.title", "location": "$.locations", "url": "$.url", "posted": "$.date", "salary_text": "$.salary"}),
    "bullhorn": ("$.data", {"title": "$.title", "location": "$.address.city", "posted": "$.dateLastPublished"}),
}
LISTS = ("jobs", "results", "data", "items", "postings", "positions")


def normalised(landed: DataFrame) -> DataFrame:
    """Postings (source, company, ord and the posting's fields) of landed JSON (ats, company, url, body).

    Each known board is a projection over one exploded variant; boards without a shape of their own take the answer
    itself or its first known list, and the first non-empty of usual names. Broken JSON gives no rows.
    """
    spark = landed.sparkSession
    parsed = landed.withColumn("v", F.try_parse_json("body")).where("v is not null")
    known = F.create_map(*[F.lit(x) for k, (p, _) in SHAPES.items() for x in (k, p)])
    lists = F.coalesce(*[F.when(known[F.col("ats")] == p, F.col("v") if p == "$" else F.try_variant_get("v", p, "variant")) for p in sorted({p for p, _ in SHAPES.values()})])
    general = F.coalesce(F.when(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.col("v")), *[F.try_variant_get("v", f"$.{k}", "variant") for k in LISTS])
    groups = F.transform(F.try_variant_get("v", "$.items", "array<variant>"), lambda g: F.coalesce(F.try_variant_get(g, "$.requisitionList", "array<variant>"), F.array().cast("array<variant>")))
    oracle = F.to_variant_object(F.flatten(groups))
    rows = parsed.withColumn("list", F.when(F.col("ats") == "oracle", oracle).when(F.col("ats").isin(*SHAPES), lists).otherwise(general)).where("list is not null")
    each = rows.select("ats", "company", "url", "list").lateralJoin(spark.tvf.variant_explode(F.col("list").outer()))
    items = each.select("ats", F.col("company").alias("firm"), F.col("url").alias("page"), F.col("pos").alias("ord"), F.col("value").alias("e"))

    def field(name: str) -> Column:
        own = []
        other = {"location": F.array_join(F.try_variant_get("e", "$.locations", "array<string>"), ", "), "url": _text("e", "$.job_url")}.get(name)
        if other is not None:
            own.append(F.when((F.col("ats") == "eightfold") & (_text("e", SHAPES["eightfold"][1][name]) == ""), other))
        for ats, (_, fields) in SHAPES.items():
            p = fields.get(name)
            if p:
                own.append(F.when(F.col("ats") == ats, _joined("e", *p) if isinstance(p, tuple) else _text("e", p)))
        usual = {"title": ("title", "name", "jobTitle"), "location": ("location", "city", "locationName"), "url": ("url", "applyUrl", "link", "href"), "posted": ("posted", "datePosted", "publishedAt", "created_at")}.get(name)
        if usual:
            own.append(F.when(~F.col("ats").isin(*SHAPES, "oracle"), first_field(F.col("e"), usual)))
        special = {"title": ("Title", "title"), "location": ("PrimaryLocation", "Location"), "posted": ("PostedDate", "PostingStartDate")}.get(name)
        if special:
            own.append(F.when(F.col("ats") == "oracle", first_field(F.col("e"), special)))
        return F.coalesce(*own, F.lit("")) if own else F.lit("")

    oracle_id = F.coalesce(first_field(F.col("e"), ("Id", "id")), F.lit(""))
    url = (
        F.when(F.col("ats") == "smartrecruiters", F.concat(F.lit("https://jobs.smartrecruiters.com/"), _text("e", "$.company.identifier"), F.lit("/"), _text("e", "$.id")))
        .when((F.col("ats") == "oracle") & ((oracle_id == "") | (F.col("page") == "")), F.lit(""))
        .when(F.col("ats") == "oracle", F.concat(F.regexp_extract("page", r"^(https?://[^/]+)", 1), F.lit("/hcmUI/CandidateExperience/en/sites/"), F.coalesce(F.nullif(F.regexp_extract("page", r"siteNumber=([^,;&]+)", 1), F.lit("")), F.lit("CX_1")), F.lit("/job/"), oracle_id))
        .when(F.col("ats") == "workday", F.concat(F.regexp_replace("page", "/wday/cxs/([^/]+)/([^/]+)/jobs.*$", "/$2"), _text("e", "$.externalPath")))
        .otherwise(field("url"))
    )
    money = lambda c: F.nullif(field(c).try_cast("double"), F.lit(0.0))
    return items.select(
        F.coalesce(F.nullif(field("company"), F.lit("")), F.col("firm")).alias("company"), field("title").alias("title"), field("location").alias("location"), url.alias("url"),
        F.col("ats").alias("source"), field("posted").alias("posted"), money("salary_min").alias("salary_min"), money("salary_max").alias("salary_max"),
        F.when(money("salary_min").isNotNull() | money("salary_max").isNotNull(), "GBP").otherwise("").alias("currency"), field("salary_text").alias("salary_text"), "ord",
    ).where("title <> ''")


def normalised_xml(landed: DataFrame, item: str, title: str, url: str, location: str, posted: str) -> DataFrame:
    """Postings of XML feeds (company, source, body): ``item`` is the element, the rest are paths below it."""
    at = lambda p: F.xpath("body", F.lit(f"//{item}/{p}/text()"))
    zipped = F.arrays_zip(at(title).alias("title"), at(url).alias("url"), at(location).alias("location"), at(posted).alias("posted"))
    return landed.select("company", "source", F.posexplode(zipped).alias("ord", "z")).select("company", "source", "ord", "z.title", "z.url", "z.location", "z.posted")


def job_counts(landed: DataFrame) -> DataFrame:
    """(ats, company, n): postings an answer holds, without reading them."""
    return normalised(landed).groupBy(F.col("source").alias("ats"), "company").agg(F.count("*").alias("n"))


def with_offset(url: Column, offset: Column, name: str = "offset") -> Column:
    """A URL's page parameter replaced, or added."""
    to = F.concat(F.lit(f"{name}="), offset.cast("string"))
    has = F.rlike(url, F.lit(rf"[?&]{name}=\d+"))
    return F.when(has, F.regexp_replace(url, F.lit(rf"{name}=\d+"), to)).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), to))


def pages_kept(landed: DataFrame, board: str, page: str, n: str, full: int, most: int) -> DataFrame:
    """Pages of each board up to its first short one (included), ``most`` at most, without empty ones."""
    w = Window.partitionBy(board).orderBy(page)
    ended = F.coalesce(F.count_if(F.col(n) < full).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = landed.withColumn("__e", ended).withColumn("__k", F.row_number().over(w))
    return rows.where((F.col("__e") == 0) & (F.col("__k") <= most) & (F.col(n) > 0)).drop("__e", "__k")


def why_stopped(landed: DataFrame, board: str, page: str, n: str, status: str, full: int, most: int) -> DataFrame:
    """(board, stopped): error, empty, short page, or the ceiling."""
    first = landed.withColumn("__why", F.when(F.col(status) >= 400, "error").when(F.col(n) == 0, "empty").when(F.col(n) < full, "short page").when(F.col(page) >= most, "ceiling"))
    return first.groupBy(board).agg(F.coalesce(F.min_by("__why", F.when(F.col("__why").isNotNull(), F.col(page))), F.lit("not finished")).alias("stopped"))


def board_totals(landed: DataFrame, site: str, n: str, cap: int) -> DataFrame:
    """(site, found, truncated): rows by site, and how many queries hit the cap."""
    return landed.groupBy(site).agg(F.sum(n).alias("found"), F.count_if(F.col(n) >= cap).alias("truncated"))


def sitemap_urls(maps: DataFrame, wanted: str, limit: int | None = None) -> DataFrame:
    """(url, ord): distinct addresses of sitemaps (ord, body) that match, in order of first appearance."""
    locs = maps.select("ord", F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("pos", "url"))
    rows = locs.where(F.rlike("url", F.lit(wanted))).groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("ord"))
    return rows.orderBy("ord").limit(limit) if limit else rows


def expanded_sitemaps(roots: DataFrame) -> DataFrame:
    """(url, ord, pos): the sitemaps to read of fetched roots (ord, url, body): the entries of an index that name jobs, any other root itself."""
    locs = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    named = F.filter(locs, lambda u: F.contains(F.lower(u), F.lit("job")))
    return roots.where("body is not null").select("ord", F.posexplode(F.when(F.contains("body", F.lit("<sitemapindex")), named).otherwise(F.array("url"))).alias("pos", "url")).select("url", "ord", "pos")


def sample_payloads(spark: SparkSession) -> DataFrame:
    """One small answer for several board shapes."""
    rows = [
        ("greenhouse", "Acme", "", '{"jobs":[{"title":"Analyst","location":{"name":"Leeds"},"absolute_url":"https://g.example/1","updated_at":"2024-01-02"}]}'),
        ("lever", "Beta", "", '[{"text":"Trader","categories":{"location":"Hull"},"hostedUrl":"https://l.example/2","createdAt":1700000000000}]'),
        ("ashby", "Core", "", '{"jobs":[{"title":"Quant","location":"Bath","jobUrl":"https://a.example/3","publishedAt":"2024-01-05","compensation":{"compensationTierSummary":"£50,000"}}]}'),
        ("smartrecruiters", "Delta", "", '{"content":[{"name":"Clerk","id":"9","location":{"city":"York"},"company":{"identifier":"delta"},"releasedDate":"2024-01-01"}]}'),
        ("workable", "Echo", "", '{"jobs":[{"title":"Dev","city":"Ely","country":"UK","url":"https://w.example/5"}]}'),
        ("oracle", "Fox", "https://fox.example/x?finder=siteNumber=CX_1,limit=5", '{"items":[{"requisitionList":[{"Id":"7","Title":"Ops","PrimaryLocation":"Rye","PostedDate":"2024-01-03"}]},{"requisitionList":[{"Id":"8","Title":"Plant","PrimaryLocation":"Rye","PostedDate":"2024-01-04"}]}]}'),
        ("workday", "Gulf", "https://gulf.wd3.example.com/wday/cxs/gulf/Ext/jobs", '{"jobPostings":[{"title":"Risk","locationsText":"Ayr","externalPath":"/job/8","postedOn":"Posted Today"}]}'),
        ("adzuna", "", "", '{"results":[{"title":"Buyer","company":{"display_name":"Hope"},"location":{"display_name":"Deal"},"redirect_url":"https://z.example/9","created":"2024-01-04","salary_min":30000,"salary_max":0}]}'),
        ("pinpoint", "Iris", "", '{"data":[{"name":"Cook","city":"Bude","link":"https://p.example/10"}]}'),
        ("comeet", "Jade", "", '[{"title":"Driver","location":{"name":"Wick"},"url":"https://c.example/11"}]'),
        ("recruitee", "Kite", "", "{broken"),
    ]
    return spark.createDataFrame(rows, "ats string, company string, url string, body string")

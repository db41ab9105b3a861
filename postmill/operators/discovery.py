"""Finding where firms publish their vacancies: board tokens, careers pages, the companies register and checks of firm pages.

Nothing here fetches: answers are landed tables of addresses with what came back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions import text as T
from postmill.functions.text import present
from postmill.functions.udfs import deaccent, url_join
from postmill.functions.web import host
from postmill.operators.fold import first_per_key


def filled(template: Column, token: Column) -> Column:
    return F.replace(template, F.lit("{t}"), token)


def shared_first_words(firms: DataFrame) -> DataFrame:
    """(first): first words that several rows of the registry share, so that they name no firm."""
    first = F.element_at(F.split(T.norm("name"), " "), 1).alias("first")
    return firms.select(first).where("first <> ''").groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first")


def board_trials(firms: DataFrame) -> DataFrame:
    """(name, category, ord, provider, token, url): every guess at a firm's token on every board, in the order to try them.

    Firms (name, category, domain) meet the boards by an unnest of a literal list, not by a join. A first word that
    others share is no guess; nor is a generic one, nor a token of two letters. Firms without a token have no row.
    """
    shared = shared_first_words(firms).withColumn("__shared", F.lit(True))
    keyed = firms.withColumn("first", F.element_at(F.split(T.norm("name"), " "), 1)).join(shared, "first", "left")
    tokens = T.board_tokens("name", "domain", fixed.GENERIC_FIRST, F.coalesce("__shared", F.lit(False)))
    boards = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(u).alias("template")) for p, u in fixed.BOARD_ENDPOINTS.items()])
    by_token = keyed.select("name", "category", F.posexplode(tokens).alias("t", "token"))
    rows = by_token.select("name", "category", "t", "token", F.posexplode(boards).alias("p", "b"))
    return rows.select("name", "category", (F.col("t") * len(fixed.BOARD_ENDPOINTS) + F.col("p")).alias("ord"), "b.provider", "token", filled(F.col("b.template"), F.col("token")).alias("url"))


def vacancies_in(provider: Column, body: Column) -> Column:
    """How many vacancies a board's answer holds; null for one of another shape."""
    v = F.try_parse_json(body)
    items = lambda path: F.array_size(F.try_variant_get(v, path, "array<variant>"))
    marks = F.nullif(F.array_size(F.split(present(body), "<item|<position>")) - 1, F.lit(0))
    return (
        F.when(provider.isin("teamtailor", "personio"), marks).when(provider.isin("greenhouse", "ashby", "workable"), items("$.jobs"))
        .when(provider.isin("lever", "breezy"), items("$")).when(provider == "smartrecruiters", F.try_variant_get(v, "$.totalFound", "int"))
        .when(provider == "bamboohr", items("$.result")).when(provider == "recruitee", items("$.offers"))
        .otherwise(F.coalesce(items("$"), *[items(f"$.{f}") for f in fixed.LIST_FIELDS]))
    )


def boards_found(trials: DataFrame, answers: DataFrame) -> DataFrame:
    """(name, category, ats, token, url, n_jobs): the first trial of each firm whose board answered (url, status, body) with vacancies."""
    hits = trials.join(answers.where("status = 200").select("url", "body"), "url").withColumn("n_jobs", vacancies_in(F.col("provider"), F.col("body"))).where("n_jobs > 0")
    return first_per_key(hits, ["name"], ["ord"]).select("name", "category", F.col("provider").alias("ats"), "token", "url", "n_jobs")


def boards_to_read(sniffed: DataFrame, guessed: DataFrame) -> DataFrame:
    """(name, ats, token, url): boards of both discoveries that can be read, each once, those read off a firm's page first.

    ``sniffed`` has name, ats, token, board_url and seq; ``guessed`` has url instead of board_url. Boards whose address can't
    be made from a token need the one that was found; others need a token and a known board.
    """
    known = fixed.BOARD_ENDPOINTS | fixed.READ_ONLY_ENDPOINTS
    templates = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    blank = F.lit("")
    both = sniffed.select(F.lit(0).alias("src"), "seq", "name", "ats", "token", F.col("board_url").alias("board"), blank.alias("given")).unionByName(
        guessed.select(F.lit(1).alias("src"), "seq", "name", "ats", "token", blank.alias("board"), F.col("url").alias("given")))
    for c in ("ats", "token", "board", "given"):
        both = both.withColumn(c, F.trim(present(c)))
    whole = F.col("ats").isin(*fixed.WHOLE_ADDRESS_BOARDS)
    fit = both.where(F.when(whole, F.col("board") != "").otherwise(F.col("ats").isin(*known) & (F.col("token") != "")))
    made = F.coalesce(F.nullif("given", blank), F.when(whole, F.col("board")).otherwise(filled(templates[F.col("ats")], F.col("token"))))
    keyed = fit.withColumns({"k": F.lower(F.when(F.col("token") != "", F.col("token")).otherwise(F.col("board"))), "url": made})
    return first_per_key(keyed, ["ats", "k"], ["src", "seq"]).select("name", "ats", "token", "url")


def careers_of(html: Column) -> Column:
    """array<string>: what the links say that a page labels as careers, by address or words, in page order."""
    of = lambda i: F.regexp_extract_all(present(html), F.lit("(?is)" + fixed.CAREERS_ANCHOR), F.lit(i))
    words = F.lit("(?i)" + fixed.CAREERS_WORDS)
    pairs = F.filter(F.arrays_zip(of(1).alias("href"), of(2).alias("label")), lambda a: F.rlike(a["href"], words) | F.rlike(F.regexp_replace(a["label"], "<[^>]+>", " "), words))
    return F.transform(pairs, lambda a: F.trim(a["href"]))


def pages_walked(log: DataFrame, follow: int = 4, readable: int = 2) -> DataFrame:
    """(firm, ord, url, kind): pages of each firm that a walk reads, from a log (firm, ord, url, status, final_url, html, guessed) of landed answers.

    Guessed addresses go in order. A refusal, or no answer to the first request to a host, ends that host. Of the first
    ``readable`` pages, the ``follow`` first careers links each are read too, each once; they are rows that aren't ``guessed``.
    """
    tried = log.where("guessed").withColumn("h", F.lower(F.element_at(F.split("url", "/"), 3)))
    by_host = Window.partitionBy("firm", "h").orderBy("ord")
    ends = F.coalesce(F.col("status").isin(*fixed.REFUSALS), F.lit(False)) | (F.col("status").isNull() & (F.row_number().over(by_host) == 1))
    ended = tried.withColumn("ends", ends).withColumn("before", F.coalesce(F.count_if("ends").over(by_host.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    read = ended.where("before = 0 and status < 400").withColumn("k", F.row_number().over(Window.partitionBy("firm").orderBy("ord")))
    seeds = read.where(F.col("k") <= readable).select("firm", "k", F.col("final_url").alias("base"), F.posexplode(careers_of(F.col("html"))).alias("pos", "href"))
    links = seeds.withColumn("link", F.regexp_replace(F.element_at(F.split(url_join("base", "href"), "#"), 1), "/+$", ""))
    links = links.where(F.startswith("link", F.lit("http")) & (host(F.col("link")) == host(F.col("base"))) & (F.col("link") != F.regexp_replace("base", "/+$", "")))
    once = links.groupBy("firm", "k", "base", "link").agg(F.min("pos").alias("pos")).withColumn("n", F.row_number().over(Window.partitionBy("firm", "k").orderBy("pos"))).where(F.col("n") <= follow)
    once = first_per_key(once, ["firm", "link"], ["k", "n"])
    landed = log.where("not guessed and status < 400").select("firm", F.regexp_replace("url", "/+$", "").alias("link"))
    followed = once.join(landed.distinct(), ["firm", "link"]).select("firm", (F.lit(1_000_000) * F.col("k") + F.col("n")).alias("ord"), F.col("link").alias("url"), F.lit("followed").alias("kind"))
    return read.select("firm", F.col("ord").cast("int").alias("ord"), F.col("final_url").alias("url"), F.lit("guessed").alias("kind")).unionByName(followed)


def titled(name: Column) -> Column:
    """Every run of letters with a capital first and small letters after."""
    parts = F.split(F.lower(name), r"(?<![\p{L}])(?=[\p{L}])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def register_screen(companies: DataFrame, existing: DataFrame, since: int = 2005, sic_category: dict[str, str] | None = None) -> DataFrame:
    """(name, category, sic, incorporated, postcode): active companies of the register worth adding to the registry (name).

    A company (seq, name, sic_codes, locality, postcode, incorporated) stays if it sits in London by locality or postcode, its
    name is none of a shell or a trade of no interest, and it was founded in ``since`` or later, or at an unknown time. Codes
    are read in the map's order, so a company, or a name that several have, takes the first code that holds it.
    """
    wanted = sic_category or fixed.SIC_CATEGORY
    at = F.create_map(*[F.lit(x) for i, c in enumerate(wanted) for x in (c, i)])
    category = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    year = F.regexp_extract(F.substring(present("incorporated"), 1, 4), r"^\d{4}$", 0)
    where = F.contains(F.lower(present("locality")), F.lit("london")) | F.rlike(F.trim(present("postcode")), F.lit("(?i)" + fixed.REGISTER_POSTCODE))
    fit = companies.where(where & ~F.rlike(present("name"), F.lit("(?i)" + fixed.REGISTER_JUNK)) & ((year == "") | (year.try_cast("int") >= since)))
    suffix = "(?i)" + fixed.NAME_SUFFIX
    bare = lambda c: F.trim(F.regexp_replace(c, suffix, ""))
    rows = fit.select("seq", bare(titled(F.trim(F.col("name")))).alias("name"), F.explode("sic_codes").alias("sic"), year.alias("incorporated"), F.trim(present("postcode")).alias("postcode"))
    rows = rows.withColumns({"__k": F.lower("name"), "__at": at[F.col("sic")], "category": category[F.col("sic")]}).where("__at is not null")
    fresh = rows.join(existing.select(F.lower(bare(F.col("name"))).alias("__k")).distinct(), "__k", "left_anti")
    return first_per_key(fresh, ["__k"], ["__at", "seq"]).select("name", "category", "sic", "incorporated", "postcode")


def firm_checked(firms: DataFrame) -> DataFrame:
    """Firms (name, domain, status, final_url, html) with verdict and detail: does the domain's page name the firm?

    No answer or an error is 'unreachable'; a refusal or a challenge page 'blocked'; a page that names the firm, by a word
    or by its letters run together, 'ok'; another site 'moved'; parked pages and those that name somebody else 'mismatch';
    pages that say too little, or in another script, 'thin'. A firm without a domain is 'ok'.
    """
    ident = deaccent(T.page_identity("html"))
    site = lambda c: F.element_at(F.split(F.replace(c, F.lit("www."), F.lit("")), ":"), 1)
    read = firms.withColumns({"__i": ident, "__t": T.name_tokens("name", "domain"), "__d": site(F.trim(present("domain"))), "__h": site(present(host(F.col("final_url"))))})
    run = F.regexp_replace("__i", "[^a-z0-9]", "")
    read = read.withColumn("__hit", F.filter("__t", lambda t: F.contains(F.col("__i"), t) | ((F.length(t) > 3) & F.contains(run, t))))
    same = F.endswith("__h", F.col("__d")) | F.endswith("__d", F.col("__h"))
    named, status = F.size("__hit") > 0, F.col("status")
    parked = F.lit(False)
    for w in fixed.PARKED:
        parked = parked | F.contains("__i", F.lit(w))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    challenge = F.rlike(F.concat_ws(" ", "__h", "__i"), F.lit("(?i)" + fixed.INTERSTITIAL))
    steps = [
        (F.trim(present("domain")) == "", "ok", F.lit("no domain claimed")), (status.isNull(), "unreachable", F.lit("no response")),
        (status.isin(*fixed.FIRM_REFUSALS), "blocked", text("http ", status.cast("string"), " — bot protection, domain probably fine")), (status >= 400, "unreachable", text("http ", status.cast("string"))),
        (~named & ~same & challenge, "blocked", text("bot challenge at ", F.col("__h"))), (named, "ok", text("page names ", F.array_join(F.slice("__hit", 1, 3), "/"))),
        (~same, "moved", text("redirects to ", F.col("__h"))), (parked, "mismatch", F.lit("parked or for-sale page")), (F.length("__i") < 40, "thin", F.lit("reachable, page says little")),
        (~T.mostly_latin("__i"), "thin", text("page is not in Latin script — cannot match the name: ", F.substring("__i", 1, 40))),
    ]
    last = text("page does not name the firm: ", F.substring("__i", 1, 60))
    decide = lambda i, other: F.coalesce(*[F.when(s[0], F.lit(s[i]) if isinstance(s[i], str) else s[i]) for s in steps], other)
    return read.withColumns({"verdict": decide(1, F.lit("mismatch")), "detail": decide(2, last)}).drop("__i", "__t", "__d", "__h", "__hit")


def block_diagnosis(counts: DataFrame, target: str) -> DataFrame:
    """One row (verdict): 'works' if the target site brought rows, 'inconclusive' if no other did either, else 'blocked'."""
    own, others = F.max(F.when(F.col("site") == target, F.col("n"))), F.max(F.when(F.col("site") != target, F.col("n")))
    return counts.agg(F.when(own > 0, "works").when(F.coalesce(others, F.lit(0)) == 0, "inconclusive").otherwise("blocked").alias("verdict"))

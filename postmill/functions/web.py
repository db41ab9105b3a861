"""Functions over URLs, pages and the JSON inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed import ASSIGNED, CAREERS_HOSTS, CAREERS_PATHS, JSON_SCRIPT, NEXT_DATA, NEXT_FLIGHT
from postmill.functions.text import present, squeeze

ANCHOR = r"""(?is)<a\b[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""
JSON_LD = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def url_key(url: Column) -> Column:
    """A URL as an identity: trimmed, without slashes at the end, lower case."""
    return F.lower(F.regexp_replace(F.trim(present(url)), "/+$", ""))


def absolute(link: Column, base: Column) -> Column:
    """A link by its shape: absolute as it is, root path on the base's host, a slug below the base; a sentence is no link."""
    l = F.trim(present(link))  # noqa: E741
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY")))
    return (
        F.when(F.rlike(l, F.lit("(?i)^https?://")), l)
        .when(F.startswith(l, F.lit("//")), F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit(":"), l))
        .when(F.startswith(l, F.lit("/")), F.concat(root, l))
        .when(F.rlike(l, F.lit(r"^[\w./?=&%#-]+$")), F.concat(F.regexp_replace(base, r"[^/]*$", ""), l))
        .otherwise("")
    )


def candidate_urls(domain: Column) -> Column:
    """Pages of a domain to try for vacancies, in order: paths of the domain, the bare host, then careers hosts."""
    apex = F.element_at(F.split(domain, "/"), 1)
    base = F.regexp_replace(apex, r"^www\.", "")
    paths = [F.concat(F.lit("https://"), domain, F.lit(p)) for p in CAREERS_PATHS]
    bare = F.when(F.startswith(apex, F.lit("www.")), F.concat(F.lit("https://"), base))
    hosts = [F.when(~F.startswith(apex, F.lit(f"{h}.")), F.concat(F.lit(f"https://{h}."), base)) for h in CAREERS_HOSTS]
    return F.filter(F.array(*paths, bare, *hosts), lambda u: u.isNotNull())


def anchors(html: Column) -> Column:
    """array<struct<href, label>> in page order; labels without tags."""
    hrefs = F.regexp_extract_all(present(html), F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(present(html), F.lit(ANCHOR), F.lit(2))
    pairs = F.arrays_zip(hrefs.alias("href"), labels.alias("label"))
    return F.transform(pairs, lambda a: F.struct(F.trim(a["href"]).alias("href"), squeeze(F.regexp_replace(a["label"], "<[^>]+>", " ")).alias("label")))


def json_ld(html: Column) -> Column:
    """array<variant> of the page's JSON-LD blocks that parse."""
    blocks = F.regexp_extract_all(present(html), F.lit(JSON_LD), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())


def state_blobs(html: Column) -> Column:
    """array<variant> of the state that page frameworks embed: next data, JSON scripts, streamed strings and window assignments."""
    of = lambda p: F.regexp_extract_all(present(html), F.lit(p), F.lit(1))
    whole = F.array_distinct(F.concat(of(NEXT_DATA), of(JSON_SCRIPT)))
    # a streamed string is JSON text in which the payload is quoted once more
    inner = F.transform(of(NEXT_FLIGHT), lambda b: F.regexp_extract(present(F.try_variant_get(F.try_parse_json(b), "$", "string")), r"(?s)\{.*\}", 0))
    found = F.concat(whole, inner, of(ASSIGNED))
    return F.filter(F.transform(found, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())


def joined_link(link: Column, field: Column, page: Column) -> Column:
    """A page's link as an address: as it is, on the page's host, or below the page for a slug; empty for a sentence.

    ``field`` is the name the link came under. Links of several parts without a leading slash resolve below the page too.
    """
    l = present(link)  # noqa: E741
    root = F.concat(F.try_parse_url(page, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(page, F.lit("AUTHORITY")))
    below = F.concat(F.regexp_replace(page, "/+$", ""), F.lit("/"))
    return (
        F.when(l == "", "").when(F.startswith(l, F.lit("http")), l).when(F.startswith(l, F.lit("//")), F.concat(present(F.try_parse_url(page, F.lit("PROTOCOL"))), F.lit(":"), l))
        .when(F.startswith(l, F.lit("/")), F.concat(present(root), l)).when((field == "slug") | (~F.contains(l, F.lit(" ")) & ~F.contains(l, F.lit("/"))), F.concat(below, F.regexp_replace(l, "^/+", "")))
        .when(F.contains(l, F.lit(" ")), "").otherwise(F.concat(below, l))
    )


def json_body(status: Column, content_type: Column, body: Column) -> Column:
    """The body as a variant if the answer is a 200 that looks like JSON, else null."""
    looks = F.contains(F.lower(present(content_type)), F.lit("json")) | F.rlike(F.ltrim(present(body)), F.lit(r"^[\[{]"))
    return F.when((status == 200) & looks, F.try_parse_json(body))


def first_field(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first non-empty of several fields of a variant; an object gives its name or label, a list its first element."""
    tries = []
    for n in names:
        for path in (f"$.{n}", f"$.{n}.name", f"$.{n}.label", f"$.{n}.text", f"$.{n}[0]", f"$.{n}[0].name"):
            got = F.try_variant_get(v, path, kind)
            got = F.when(~F.rlike(got, F.lit(r"^\s*[\[{]")), got) if kind == "string" else got
            tries.append(F.nullif(F.trim(got), F.lit("")) if kind == "string" else got)
    return F.coalesce(*tries)


def all_labels(text: Column, patterns: dict[str, str]) -> Column:
    """Every label whose pattern the text holds, in the patterns' order."""
    return F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def first_label(text: Column, patterns: dict[str, str]) -> Column:
    """struct(label, token) of the first pattern that matches, in order; group 1 is the token."""
    kind = "struct<label:string,token:string>"
    return F.coalesce(*[
        F.when(F.rlike(text, F.lit(p)), F.struct(F.lit(k).alias("label"), F.regexp_extract(text, p, 1 if "(" in p.replace("(?", "") else 0).alias("token"))) for k, p in patterns.items()
    ]).cast(kind)

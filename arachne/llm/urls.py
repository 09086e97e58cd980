"""URL filtering: rules by host and path, and a list of URLs behind a blocked Bloom filter, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.llm import shared as S

#: Urls that a block of the filter (8 words of 32 bits) holds: about one unlisted url in a thousand then passes.
PER_BLOCK = 16
#: Blocks at most: 8 MB of words are broadcast, whatever the list's length. A list of more than MOST_BLOCKS * PER_BLOCK
#: (4 million) urls makes the filter pass more rows on to the exact join; it never loses one.
MOST_BLOCKS = 1 << 18

#: (verdict, host, path prefix). Fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> str:
    """SQL: the host of a url column, A-Z lower-cased; empty without ://."""
    return f"coalesce(translate(regexp_extract({url}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"


def path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def canonical(url: str) -> str:
    """SQL: the url without scheme, www., default port, fragment, tracking parameters and last slash; parameters sorted. Null without a host."""
    bare = f"regexp_replace(regexp_replace({host(url)}, '^www[.]', ''), ':(80|443)$', '')"
    args = f"array_sort(filter(split(regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1), '&'), p -> p <> '' and not p rlike '^(utm_[a-z]*|ref|fbclid|gclid)='))"
    return f"nullif(concat({bare}, regexp_replace({path(url)}, '/+$', ''), if(size({args}) > 0, concat('?', array_join({args}, '&')), '')), '')"


def _bits(key: str) -> list[Column]:
    """One bit in each of the 8 words, by 5 bits of a second hash."""
    return [F.expr(f"shiftleft(1, cast(shiftrightunsigned(xxhash64({key}, 1), {5 * k}) & 31L as int))") for k in range(8)]


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, w0 .. w7), at most blocks of them: the words of each block with one bit set for each key."""
    own = listed.select(F.expr(f"cast(pmod(xxhash64({key}), {blocks}) as int)").alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(key))])
    return own.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(8)])


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of pages. listed: (canonical), the urls to block.

    The longest rule that fits decides; a rule fits its host and the subdomains of it, if the path starts with the
    rule's. Where none fits, a page is blocked if its canonical url is listed. The filter, sized by the counted list up to
    MOST_BLOCKS, is broadcast; rows that it passes are joined with the list itself. Cases: a null or empty url, or one
    without ://, has an empty host and path, fits no rule and is allowed; very long urls are judged whole; rows that
    repeat, and null ids, are judged each; ties don't arise, as no two rules that fit a url are equally long; a null in
    the list matches nothing; repeats in the list count once; an empty table gives an empty result, an empty list blocks
    nothing; other columns are ignored.
    """
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in order]
    pick = lambda what: F.coalesce(*[F.when(f, F.lit(w)) for f, w in zip(fits, what, strict=True)]) if fits else F.lit(None).cast("string")
    listed = S.saved(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    blocks = min(MOST_BLOCKS, max(1, 1 << (-(-listed.count() // PER_BLOCK) - 1).bit_length()))
    url = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u"))
    judged = url.select("page_id", F.expr(host("u")).alias("host"), F.expr(path("u")).alias("path"), F.expr(canonical("u")).alias("canonical"))
    judged = judged.withColumns({"rule": pick([h + p for _, h, p in order]), "ruled": pick([v for v, _, _ in order])})
    words = F.broadcast(bloom_filter(listed, "canonical", blocks))
    hit = F.expr(" and ".join(f"(w{k} & shiftleft(1, cast(shiftrightunsigned(xxhash64(canonical, 1), {5 * k}) & 31L as int))) <> 0" for k in range(8)))
    probed = judged.withColumn("block", F.expr(f"cast(pmod(xxhash64(canonical), {blocks}) as int)")).join(words, "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col("ruled").isNull() & F.col("canonical").isNotNull())
    cols = ["page_id", "host", "path", "rule"]
    clear = probed.where("not maybe").select(*cols, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    exact = probed.where("maybe").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    return clear.union(exact.select(*cols, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")))


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list of the query: canonical urls under which two or more pages were fetched."""
    return pages.select(F.expr(canonical(url_col)).alias("canonical")).where("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")


def oracle() -> str:
    h = "coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '%s', '%s'), '')" % (_UPPER, _LOWER)
    p = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    args = "list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)=')))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{value(r)}'" for r in order) + " END"
    return f"""
WITH a AS (SELECT page_id, url, {h} AS host, {p} AS path, {args} AS args FROM pages),
c AS (SELECT *, nullif(regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
             || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END, '') AS canonical FROM a),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule,
       coalesce({case(lambda r: r[0])}, CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c"""

"""Source adapters: a platform's JSON as one row of the item model.

Each takes a JSON string Column and gives a struct of ``FIELDS``; null where the platform's
row is none of ours (deleted, no text, no address).  What a platform does not say is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.mathx import null_aware_sum
from tidemark.functions.text import strip_html

FIELDS = {
    "external_id": "string", "url": "string", "title": "string", "body": "string", "content_type": "string", "author_id": "string", "author_name": "string",
    "published_at": "bigint", "views": "bigint", "likes": "bigint", "comments": "bigint", "shares": "bigint", "native_score": "bigint", "hashtags": "array<string>",
}
LONGEST_TITLE, LONGEST_BODY = 200, 1200
# Pages of an encyclopedia that are no articles.
NO_ARTICLE = ("Special:", "Category:", "Template:", "File:", "Help:", "Portal:", "Talk:", "User:", "Wikipedia:")
MAIN_PAGES = ("Main_Page", "-")


def _row(**values: Column) -> Column:
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()])


def _iso(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _first_line(text: Column) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, LONGEST_TITLE)


def wikipedia(raw: Column) -> Column:
    """Daily views of {article, views, language, day}; main pages and other name spaces are none."""
    x = F.from_json(raw, "article string, views bigint, language string, day string")
    is_article = ~x["article"].isin(*MAIN_PAGES)
    for prefix in NO_ARTICLE:
        is_article = is_article & ~x["article"].startswith(prefix)
    row = _row(
        external_id=F.concat_ws(":", x["language"], x["day"], x["article"]),
        url=F.concat(F.lit("https://"), x["language"], F.lit(".wikipedia.org/wiki/"), F.replace(F.url_encode(x["article"]), F.lit("+"), F.lit("%20"))),
        title=F.replace(x["article"], F.lit("_"), F.lit(" ")),
        content_type=F.lit("text"),
        published_at=_iso(x["day"]),
        views=x["views"],
    )
    return F.when(is_article, row)


def hackernews(raw: Column) -> Column:
    """Stories that are alive; a story without address is text."""
    x = F.from_json(raw, "id bigint, type string, by string, time bigint, title string, url string, text string, score bigint, descendants bigint, dead boolean, deleted boolean")
    alive = x["title"].isNotNull() & ~F.coalesce(x["type"] == "comment", F.lit(False)) & ~F.coalesce(x["dead"], F.lit(False)) & ~F.coalesce(x["deleted"], F.lit(False))
    row = _row(
        external_id=x["id"],
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), x["id"].cast("string")),
        title=x["title"],
        body=F.coalesce(x["url"], x["text"]),
        content_type=F.when(x["url"].isNull(), "text").otherwise("link"),
        author_id=x["by"],
        author_name=x["by"],
        published_at=x["time"],
        comments=x["descendants"],
        native_score=x["score"],
    )
    return F.when(alive, row)


def reddit(raw: Column) -> Column:
    """Posts of a listing; pinned ones are none."""
    x = F.from_json(raw, "id string, title string, selftext string, author string, permalink string, url string, created_utc double, score bigint, num_comments bigint, num_crossposts bigint, is_video boolean, is_self boolean, post_hint string, stickied boolean")
    image = F.coalesce(x["post_hint"] == "image", F.lit(False)) | F.coalesce(x["url"].rlike(r"(?i)\.(jpg|jpeg|png|gif|webp)$"), F.lit(False))
    row = _row(
        external_id=x["id"],
        url=F.concat(F.lit("https://www.reddit.com"), x["permalink"]),
        title=x["title"],
        body=_filled(x["selftext"]),
        content_type=F.when(x["is_video"], "video").when(image, "image").when(x["is_self"], "text").otherwise("link"),
        author_id=x["author"],
        author_name=x["author"],
        published_at=F.floor(x["created_utc"]),
        comments=x["num_comments"],
        shares=x["num_crossposts"],
        native_score=x["score"],
    )
    return F.when(x["title"].isNotNull() & ~F.coalesce(x["stickied"], F.lit(False)), row)


def mastodon(raw: Column) -> Column:
    """Statuses; the address that all servers share names a status, its parts sum to its score."""
    x = F.from_json(raw, "id string, url string, uri string, host string, created_at string, content string, favourites_count bigint, reblogs_count bigint, replies_count bigint, account struct<acct: string, display_name: string>, media_attachments array<struct<type: string>>, tags array<struct<name: string>>")
    text = strip_html(x["content"])
    kinds = F.coalesce(F.transform(x["media_attachments"], lambda m: m["type"]), F.array().cast("array<string>"))
    acct = x["account"]["acct"]
    row = _row(
        external_id=F.coalesce(x["uri"], x["url"], F.concat_ws(":", x["host"], x["id"])),
        url=F.coalesce(x["url"], x["uri"]),
        title=F.coalesce(_filled(_first_line(text)), F.concat(F.lit("post by "), F.coalesce(acct, F.lit("unknown")))),
        body=_filled(F.substring(text, 1, LONGEST_BODY)),
        content_type=F.when(F.arrays_overlap(kinds, F.array(F.lit("video"), F.lit("gifv"))), "video").when(F.array_contains(kinds, "image"), "image").otherwise("text"),
        author_id=acct,
        author_name=F.coalesce(_filled(x["account"]["display_name"]), acct),
        published_at=_iso(x["created_at"]),
        likes=x["favourites_count"],
        shares=x["reblogs_count"],
        comments=x["replies_count"],
        native_score=null_aware_sum([x["favourites_count"], x["reblogs_count"], x["replies_count"]]),
        hashtags=F.filter(F.transform(F.coalesce(x["tags"], F.array().cast("array<struct<name: string>>")), lambda t: F.lower(t["name"])), lambda t: t != ""),
    )
    return F.when((F.coalesce(text, F.lit("")) != "") | (F.size(kinds) > 0), row)


def bluesky(raw: Column) -> Column:
    """Posts with a text and an address that a browser opens."""
    x = F.from_json(raw, "uri string, author struct<did: string, handle: string, displayName: string>, record struct<text: string, createdAt: string>, embed struct<`$type`: string>, likeCount bigint, repostCount bigint, replyCount bigint, quoteCount bigint")
    text, handle, kind = x["record"]["text"], x["author"]["handle"], F.coalesce(x["embed"]["$type"], F.lit(""))
    address = r"^at://([^/]+)/app\.bsky\.feed\.post/(.+)$"
    post = _filled(F.regexp_extract(x["uri"], address, 2))
    row = _row(
        external_id=x["uri"],
        url=F.concat(F.lit("https://bsky.app/profile/"), F.coalesce(handle, F.regexp_extract(x["uri"], address, 1)), F.lit("/post/"), post),
        title=F.coalesce(_filled(_first_line(text)), F.substring(text, 1, LONGEST_TITLE)),
        body=F.substring(text, 1, LONGEST_BODY),
        content_type=F.when(kind.contains("video"), "video").when(kind.contains("images"), "image").when(kind.contains("external"), "link").otherwise("text"),
        author_id=F.coalesce(handle, x["author"]["did"]),
        author_name=F.coalesce(_filled(x["author"]["displayName"]), handle),
        published_at=_iso(x["record"]["createdAt"]),
        likes=x["likeCount"],
        shares=x["repostCount"],
        comments=x["replyCount"],
        native_score=null_aware_sum([x["likeCount"], x["repostCount"], x["replyCount"], x["quoteCount"]]),
        hashtags=F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]{2,40})"), 1), F.lower)),
    )
    return F.when((text != "") & post.isNotNull(), row)


def github(raw: Column) -> Column:
    """Repositories found by creation date; stars are the score."""
    x = F.from_json(raw, "id bigint, full_name string, html_url string, description string, topics array<string>, created_at string, stargazers_count bigint, forks_count bigint, open_issues_count bigint, owner struct<login: string>")
    row = _row(
        external_id=x["id"],
        url=x["html_url"],
        title=x["full_name"],
        body=x["description"],
        content_type=F.lit("link"),
        author_id=x["owner"]["login"],
        author_name=x["owner"]["login"],
        published_at=_iso(x["created_at"]),
        shares=x["forks_count"],
        comments=x["open_issues_count"],
        native_score=x["stargazers_count"],
        hashtags=x["topics"],
    )
    return F.when(x["full_name"].isNotNull(), row)


def popularity_score(popularity: Column) -> Column:
    """A small decimal figure in hundredths, so that its lower half does not round away."""
    return F.floor(popularity * 100 + 0.5).cast("long")


ADAPTERS: dict[str, Callable[[Column], Column]] = {"wikipedia": wikipedia, "hackernews": hackernews, "reddit": reddit, "mastodon": mastodon, "bluesky": bluesky, "github": github}


def items_of(raw: DataFrame, source: str, column: str = "raw") -> DataFrame:
    """Rows of one platform's JSON as items; the first of rows with one id of the platform's
    stays (by its text), and refused rows go."""
    rows = raw.select(ADAPTERS[source](F.col(column)).alias("x")).where("x is not null").select("x.*")
    first = rows.groupBy("external_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "external_id"])).alias("x"))
    return first.select(F.lit(source).alias("source"), "external_id", "x.*")

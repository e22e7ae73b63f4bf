"""Views, records and files of the portal: what is shown, saved and indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import blank, filled, source_name

from .dedup import keep_first
from .gates import research
from .rank import top_per_group


def watched_feed(items: DataFrame, watched: str, category: str, section: str, url: str, date: str) -> DataFrame:
    """Watched authors' papers that are graded and not off topic, no practitioners' pieces, each link once: the newest."""
    ok = items.filter(F.coalesce(F.col(watched), F.lit(False)) & (F.col(category) != "off_topic") & research(F.col(section)))
    return keep_first(ok, [url], [F.desc_nulls_last(date), F.col("uid")])


def month_listing(items: DataFrame, month: Column, wanted: str, cites: str, classic: Column) -> DataFrame:
    """A month's papers with `rank` by citations, and the number of classics among them on every row."""
    own = items.filter(month == wanted).withColumns({"month": month, "classic": classic})
    count = own.groupBy("month").agg(F.count_if("classic").alias("n_classics"))
    return top_per_group(own.join(count, "month"), ["month"], [F.desc_nulls_last(cites), F.col("uid")], 1 << 30)


def saved_view(saved: DataFrame, text: list[str], query: str, facet: Column | None = None) -> DataFrame:
    """Saved items (savedAt) that contain the query in one of their texts and pass the facet, the last saved first."""
    hit = F.contains(F.lower(F.concat_ws(" ", *text)), F.lit(query.lower()))
    return saved.filter(hit if facet is None else hit & facet).orderBy(F.desc("savedAt"), "uid")


def kept_chats(turns: DataFrame, chat: str, turn: str, done: str, touched: str, chats: int = 20, last: int = 12) -> DataFrame:
    """What is stored of the conversations of each `owner`: the `chats` touched last, the `last` finished turns of each."""
    recent = top_per_group(turns.groupBy("owner", chat).agg(F.max(touched).alias("__t")), ["owner"], [F.desc("__t"), F.col(chat)], chats).select("owner", chat)
    finished = turns.filter(F.coalesce(F.col(done), F.lit(False))).join(recent, ["owner", chat], "left_semi")
    return top_per_group(finished, ["owner", chat], [F.desc(turn)], last).drop("rank")


def shard_lookup(picks: DataFrame, shards: DataFrame, row: str, cached: DataFrame, width: int = 64) -> DataFrame:
    """Abstracts of picked vector rows from shards of `width` rows (shard, abstracts: array); cached rows are left out."""
    wanted = picks.join(cached.select(row), row, "left_anti").withColumns({"shard": F.floor(F.col(row) / width), "__at": (F.col(row) % width).cast("int")})
    return wanted.join(shards, "shard").select(row, "shard", F.get("abstracts", F.col("__at")).alias("abstract"))


def topic_counts(canon: DataFrame, topic: str, alias: dict[str, str]) -> DataFrame:
    """How many works of the canon each topic has, after renaming by `alias`."""
    named = F.coalesce(*[F.when(F.col(topic) == a, F.lit(b)) for a, b in alias.items()], F.col(topic))
    return canon.groupBy(named.alias("topic")).agg(F.count("*").alias("n"))


def prior_art(known: DataFrame, canon: DataFrame) -> DataFrame:
    """(block): one text with a line for each known antecedent, in their order, or if there are none at all for each method work
    of the canon.

    known: pos, title, authors, year, note, cites; canon: pos, title, kind, why.  A line has the title, then authors and
    year in brackets, then the note or else the citations, each only if there is one.  Both are curated lists, so the block
    is a bounded text.
    """
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    who = F.nullif(F.concat_ws(" ", some("authors"), some("year")), F.lit(""))
    tail = F.coalesce(some("note"), F.when(F.col("cites") != 0, F.concat(F.format_number("cites", 0), F.lit(" citations"))))
    line = F.concat(F.lit("- "), filled(F.col("title")), F.coalesce(F.concat(F.lit(" ("), who, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), tail), F.lit("")))
    method = canon.filter("kind = 'Method'").select(F.lit(1).alias("b"), "pos", F.concat(F.lit("- "), filled(F.col("title")), F.lit(": "), filled(F.col("why"))).alias("l"))
    both = known.select(F.lit(0).alias("b"), "pos", line.alias("l")).unionByName(method)
    lines = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("b") == b, F.struct("pos", "l")))), lambda x: x["l"])
    return both.agg(lines(0).alias("k"), lines(1).alias("c")).select(F.array_join(F.when(F.size("k") > 0, F.col("k")).otherwise(F.col("c")), "\n").alias("block"))


def canon_items(canon: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The canon's works (key, title, author, year) with what was found for them, else with a link that searches for them."""
    r = found.select(key, *[F.col(c).alias(f"__{c}") for c in ("title", "authors", "journal", "year", "cites", "url")], F.lit(True).alias("__found"))
    link = F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode("title"))
    return canon.join(r, key, "left").select(
        key, F.coalesce("__title", "title").alias("title"), F.coalesce(F.nullif("__authors", F.lit("")), "author").alias("authors"), F.coalesce("__journal", F.lit("")).alias("journal"),
        F.coalesce("__year", "year").alias("year"), "__cites", F.when(F.col("__found"), F.coalesce("__url", F.lit(""))).otherwise(link).alias("url")).withColumnRenamed("__cites", "cites")


def classic_item(df: DataFrame, year: str) -> DataFrame:
    """Works of the canon as items: dated the first day of their year, marked as classic."""
    return df.withColumns({"date": F.format_string("%04d-01-01", F.col(year).cast("int")), "classic": F.lit(True)})


def slim(items: DataFrame, columns: list[str], abstract: str, most: int = 400) -> DataFrame:
    """A few fields, with the first characters of the abstract (a preview) and no citations yet."""
    return items.select(*columns, F.substring(filled(F.col(abstract)), 1, most).alias(abstract), F.lit(None).cast("long").alias("cites"))


def source_label(sources: Column) -> Column:
    """An item's sources without their kinds, joined by commas."""
    return F.array_join(F.transform(sources, source_name), ", ")


def kv_get(table: DataFrame, wanted: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The value of each wanted key, or the default."""
    return wanted.select(key).join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def progress(table: DataFrame, month: str) -> DataFrame:
    """Stored progress with its list of ids; a list that can't be read is empty."""
    return table.select(month, "done", F.coalesce(F.from_json("ids", "array<string>"), F.array().cast("array<string>")).alias("ids"))


def classics_index(canon: DataFrame, cited: DataFrame, topic: str, most: int = 400) -> DataFrame:
    """(block, topic, place, title): the canon by topic and year, then the most cited works, numbered within each."""
    a = canon.select(F.lit(0).alias("block"), F.col(topic).alias("topic"), F.row_number().over(Window.partitionBy(topic).orderBy("year", "title")).alias("place"), "title")
    top = cited.orderBy(F.desc_nulls_last("cites"), "title").limit(most)
    b = top.select(F.lit(1).alias("block"), F.lit("").alias("topic"), F.row_number().over(Window.orderBy(F.desc_nulls_last("cites"), "title")).alias("place"), "title")  # `most` rows
    return a.unionByName(b)


def classic_line(title: Column, authors: Column, year: Column, journal: Column, full: Column, cites: Column, kind: Column, url: Column, why: Column) -> Column:
    """A work of the classics index in Markdown: title, a line of who, when and where, a line of marks, the link and the note."""
    some = lambda c: F.nullif(F.trim(filled(c)), F.lit(""))
    where = F.nullif(F.concat_ws(" · ", some(F.substring(F.trim(filled(authors)), 1, 70)), some(F.substring(filled(year.cast("string")), 1, 4)), some(F.substring(F.trim(filled(journal)), 1, 40))), F.lit(""))
    marks = F.nullif(F.concat_ws(" · ", F.when(full, "full text"), F.when(cites != 0, F.concat(F.format_number(cites, 0), F.lit(" cites"))), some(F.lower(kind))), F.lit(""))
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(F.lit("- **"), F.trim(filled(title)), F.lit("**"), part("  \n  ", where), part("  \n  _", marks, "_"), part(" — [link](", some(url), ")"), part("  \n  ", some(why)))


def classics_lines(works: DataFrame, line: Column, most: int = 400) -> DataFrame:
    """(block, topic, place, line) of the classics index, with headings that count.

    works: uid, title, topic (null for works that are not in the canon), year, cites, full.  Block 0 counts all works and
    those with a full text; block 1 has the canon by topic, heading at place 0, by year; block 2 the `most` most cited.
    """
    rows = works.withColumn("__line", line)
    total = rows.agg(F.count("*").alias("n"), F.count_if("full").alias("f")).select(F.lit(0).alias("block"), F.lit("").alias("topic"), F.lit(0).alias("place"), F.format_string("**%s papers** · **%s** with full text parsed", F.col("n").cast("string"), F.col("f").cast("string")).alias("line"))
    canon = rows.filter(F.col("topic").isNotNull())
    heads = canon.groupBy("topic").agg(F.count("*").alias("n")).select(F.lit(1).alias("block"), "topic", F.lit(0).alias("place"), F.format_string("### %s (%s)", "topic", F.col("n").cast("string")).alias("line"))
    inside = canon.select(F.lit(1).alias("block"), "topic", F.row_number().over(Window.partitionBy("topic").orderBy(filled(F.col("year").cast("string")), "title", "uid")).alias("place"), F.col("__line").alias("line"))
    others = rows.filter(F.col("topic").isNull())
    best = [F.desc(F.coalesce("cites", F.lit(0))), F.col("title"), F.col("uid")]
    top = others.orderBy(*best).limit(most).select(F.lit(2).alias("block"), F.lit("").alias("topic"), F.row_number().over(Window.orderBy(*best)).alias("place"), F.col("__line").alias("line"))  # `most` rows
    head = others.agg(F.count("*").alias("n")).select(F.lit(2).alias("block"), F.lit("").alias("topic"), F.lit(0).alias("place"), F.format_string("## Most-cited (%s)", F.col("n").cast("string")).alias("line"))
    return total.unionByName(heads).unionByName(inside).unionByName(head).unionByName(top)


def pdf_status(files: DataFrame, size: str, content: str, most: int = 60_000_000) -> Column:
    """What became of a download: missing, too large, not a PDF, or ok."""
    return F.when(F.col(content).isNull(), "missing").when(F.col(size) > most, "too_large").when(F.substring(F.hex(content), 1, 8) != "25504446", "not_pdf").otherwise("ok")


def write_passages(passages: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Passages as JSON lines, a document's in one bucket, in order; documents of the buckets that `passages` has replace
    theirs.  Files are written by tasks and count once the job is committed, so a failed task leaves none."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    rows = passages.select("*", bucket)
    rows.repartition("bucket", key).sortWithinPartitions("bucket", key, *[c for c in ("section", "passage") if c in passages.columns]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One line for each document with committed passages below `path`: their number and words; `key` as in a schema."""
    rows = spark.read.schema(f"{key}, words long, bucket int").json(path)
    return rows.groupBy(rows.columns[0]).agg(F.count("*").alias("n_passages"), F.sum("words").alias("n_words"))


def saved_of(saved: DataFrame, users: DataFrame, user: str, value: str) -> DataFrame:
    """What each user has saved as JSON, `{}` if nothing; users without a name get null."""
    known = users.join(saved, user, "left")
    return known.select(user, F.when(~blank(F.col(user)), F.coalesce(value, F.lit("{}"))).alias(value))

"""WARC archives of pages, written and read back by boundary chains.

Writing: pages of equal payloads of at least ``least_bytes`` are known by length
and digest; one grouped aggregation finds the largest id of each group, whose
page is the response, and the others become revisits without a payload. Records
are text rows whose line separator is the record end, so Spark's own writer makes
the files.

Reading: Spark's text source splits archives anywhere and cuts them at every
occurrence of the version line. Each piece is a candidate record; with the
lengths of all pieces before it (summed within splits and over a file's splits)
it has an offset, and its header names its successor's. Version lines inside
payloads make candidates as well, so the chain is verified from the file's start:

* within a split, pointers are followed to the split's exit in a grouped job;
* from offset 0 of each file, pointer jumping over the exits (as many rounds as
  the logarithm of a file's splits) finds where the true chain enters each split;
* from there the records on the chain are marked, and all others are rejected.

A record that holds version lines lies in several pieces; only files with such
records are read again, with their texts, to join the pieces. No task holds more
than the places of the pieces of one split or file, or one record.

Defined cases: a null html is an empty payload; a null id sorts before all others
and is written as nothing; rows that repeat the largest id of a group are all
responses; line breaks in a url are percent-encoded; a record that ends past the
end of its file is rejected, and so is all of a file that does not begin with a
version line; an empty table makes an archive without records. A record may have
2 GB at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_workers, scratch_path, stage

LEAST_BYTES, BROADCAST_ROWS, MOST_NAMES, MOST_ROUNDS = 1000, 200_000, 10_000, 60
# Fixed values of the WARC and HTTP formats.
END = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a record carries besides its place: fields of its header, and what its payload shows.
PARSED = ("record_type", "urn", "refers", "told_digest", "is_http")
PAYLOAD = ("payload_bytes", "payload_digest", "intact")


# writing


def _marked(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): refers_to of revisits alone."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), "_url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    groups = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest", "size").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "size", "kept")
    )
    groups = stage(groups, "equal-payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    refers = F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.join(groups, ["digest", "size"], "left").select("id", "_url", "payload", "size", "digest", refers.alias("refers_to"))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(value.cast("string")), F.lit("")), F.lit(">"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    date: str | None = None,
) -> None:
    """Write a record of every row below ``path``; ``date`` is that of the records, now where it is not given."""
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = _marked(pages.select(F.col(id_col), url.alias("_url"), F.col(html_col)), id_col, html_col, least_bytes)
    now = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = F.col("refers_to").isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", now),
        line("WARC-Target-URI", F.col("_url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(again, _urn(F.col("refers_to")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


# reading


def _field(head: Column, name: str, value: str = r"([^\r\n]*?)") -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*{value}[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _page(urn: Column, kind: str) -> Column:
    found = F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1)
    return F.when(found != "", F.url_decode(found)).cast(kind)


def _pieces(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, block, file_size, seq, value) of the pieces between version lines."""
    return spark.read.option("lineSep", version).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("seq"), "value",
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``size`` in bytes and, where a header stands first, its fields and ``need``, the bytes it asks for."""
    head = F.substring_index("value", END, 1)
    size, used = F.octet_length("value").cast("long"), F.octet_length(head).cast("long")
    headed = used < size
    rows = pieces.withColumns({"size": size, "head": F.when(headed, head)})
    rows = rows.withColumns({
        "block_bytes": _field(F.col("head"), "Content-Length", r"(\d{1,18})").cast("long"),
        "body": F.octet_length("head").cast("long") + 4,  # where the block begins
        "record_type": _field(F.col("head"), "WARC-Type"),
        "urn": _field(F.col("head"), "WARC-Record-ID"),
        "refers": _field(F.col("head"), "WARC-Refers-To"),
        "told_digest": F.lower(_field(F.col("head"), "WARC-Payload-Digest", r"(?:sha1:)?([^\r\n]*?)")),
        "is_http": F.lower(F.coalesce(_field(F.col("head"), "Content-Type"), F.lit(""))).startswith("application/http"),
    })
    rows = rows.withColumn("need", F.col("body") + F.col("block_bytes") + 4)
    return rows.withColumn("complete", F.coalesce((F.col("need") == F.col("size")) & F.endswith("value", F.lit(END)), F.lit(False))).drop("head")


def _with_payload(rows: DataFrame, block: Column, keep_payload: bool) -> DataFrame:
    """Length and digest of the payload in the bytes ``block`` (null: none); of revisits what their headers say."""
    text = block.cast("string")
    head = F.substring_index(text, END, 1)
    split = F.col("is_http") & (F.octet_length(head) < F.octet_length(block))
    rows = rows.withColumns({
        "http_head": F.when(split, head),
        "payload": F.when(split, F.substr(block, F.octet_length(head) + 5, F.octet_length(block))).otherwise(block),
    })
    again = F.col("record_type") == "revisit"
    rows = rows.withColumns({"own_bytes": F.octet_length("payload").cast("long"), "own_digest": F.sha1("payload")})
    rows = rows.withColumns({
        "payload_bytes": F.when(again, _field(F.col("http_head"), "Content-Length", r"(\d{1,18})").cast("long")).otherwise(F.col("own_bytes")),
        "payload_digest": F.when(again, F.col("told_digest")).otherwise(F.col("own_digest")),
        "intact": F.when(again, F.col("own_bytes") == 0).otherwise(F.coalesce(F.col("told_digest") == F.col("own_digest"), F.lit(True))),
    })
    return rows.drop("http_head", "own_bytes", "own_digest", *([] if keep_payload else ["payload"]))


def _placed(rows: DataFrame, version: str) -> DataFrame:
    """``rows`` with ``at``, the offset of the version line before each piece, and ``next``, its successor's."""
    step = F.col("size") + len(version)
    sums = rows.groupBy("file", "block").agg(F.sum(step).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    at = F.col("base") + F.col("own") - len(version)  # a file's first piece is what stands before its first version line
    after = at + len(version) + F.col("need")
    return own.join(base, ["file", "block"]).withColumns({"at": at, "next": F.when(after <= F.col("file_size"), after)}).drop("own", "base")


def _hits(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each successor among the candidates, and whether it is one."""
    place = np.minimum(np.searchsorted(at, after), len(at) - 1)
    return place, at[place] == after


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves it or breaks, by pointer jumping."""
    rows = rows.sort_values("at")
    at, after = rows["at"].to_numpy(), rows["next"].to_numpy()
    place, hit = _hits(at, after)
    last = np.where(hit, place, np.arange(len(at)))
    while (last[last] != last).any():
        last = last[last]
    return pd.DataFrame({"file": rows["file"], "at": at, "exit": after[last]})


def _on_chain(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entry reaches."""
    rows = rows.sort_values("at")
    at = rows["at"].to_numpy()
    keep = np.zeros(len(at), bool)
    if len(at):
        place, hit = _hits(at, rows["next"].to_numpy())
        places, hits = place.tolist(), hit.tolist()
        for entry in entries["at"].tolist():
            i = int(np.searchsorted(at, entry))
            while not keep[i]:
                keep[i] = True
                i = places[i] if hits[i] else i
    return pd.DataFrame({"file": rows["file"], "at": at})[keep]


def _entries(candidates: DataFrame) -> DataFrame:
    """(file, at): where each file's chain from offset 0 enters its splits."""
    exits = stage(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, at long, exit long"), "exits")
    targets = exits.select("file", F.col("exit").alias("at")).unionByName(exits.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    hops = stage(exits.join(targets, ["file", "at"]), "hops")
    reached = hops.where("at = 0").select("file", "at")
    jump, known = hops, reached.count()
    for _ in range(MOST_ROUNDS):
        # only places where a candidate stands are entries
        met = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).join(hops.select("file", "at"), ["file", "at"], "left_semi")
        reached = stage(reached.unionByName(met).distinct(), "entries")
        now = reached.count()
        if now == known:
            return reached
        known = now
        further = jump.select("file", F.col("exit").alias("at"), F.col("at").alias("from")).join(jump, ["file", "at"])
        jump = stage(further.select("file", F.col("from").alias("at"), "exit"), "jumps")
    raise RuntimeError(f"a chain goes on after {MOST_ROUNDS} rounds")


def _chain(placed: DataFrame) -> DataFrame:
    """(file, at) of the records that the start of their file reaches."""
    candidates = on_workers(placed.where(F.col("next").isNotNull()).select("file", "block", "at", "next"))
    entries = _entries(candidates).join(candidates.select("file", F.col("block").alias("within"), "at"), ["file", "at"])
    return candidates.groupBy("file", "block").cogroup(entries.groupBy("file", "within")).applyInPandas(_on_chain, "file string, at long")


def _joined_pieces(placed: DataFrame, chain: DataFrame, texts: DataFrame, version: str) -> DataFrame:
    """(file, at, block_text) of the records on the chain that lie in several pieces."""
    on = chain.withColumn("on_chain", F.lit(True))
    rows = placed.select("file", "block", "seq", "at", "next", "complete", "body", "block_bytes").join(on, ["file", "at"], "left")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("on_chain"), F.struct("at", "next", "complete", "body", "block_bytes"))
    rows = rows.withColumn("own", F.last(own, ignorenulls=True).over(upto))
    rows = rows.where(~F.col("own.complete") & (F.col("at") < F.col("own.next")))
    parts = rows.join(texts.select("file", "block", "seq", "value"), ["file", "block", "seq"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("value")))), lambda x: x["value"]), version)
    found = parts.groupBy("file", F.col("own.at").alias("start"), F.col("own.body").alias("body"), F.col("own.block_bytes").alias("n")).agg(whole.alias("w"))
    return found.select("file", F.col("start").alias("at"), F.substr(F.col("w").cast("binary"), (F.col("body") + 1).cast("int"), F.col("n").cast("int")).alias("block_text"))


def read_warc(
    spark: SparkSession, path: str, id_type: str = "long", version: str = VERSION, keep_payload: bool = False
) -> DataFrame:
    """(file, at, record_type, page_id, refers_to, payload_bytes, payload_digest, intact[, payload]) of every record.

    ``payload_bytes`` and ``payload_digest`` are those of the payload as read, of
    a revisit those that its headers tell; ``intact``: the payload has the digest
    that its header tells, a revisit has none.
    """
    carried = [*PARSED, *PAYLOAD, *(["payload"] if keep_payload else [])]
    places = ["file", "block", "file_size", "seq", "size", "need", "complete", "body", "block_bytes"]
    rows = _parsed(_pieces(spark, path, version))
    block = F.when(F.col("complete"), F.substr(F.col("value").cast("binary"), (F.col("body") + 1).cast("int"), F.col("block_bytes").cast("int")))
    rows = stage(_with_payload(rows, block, keep_payload).select(*places, *carried), "pieces")
    odd = stage(rows.where(~F.col("complete") & (F.col("size") > 0)).select("file").distinct(), "odd-files")
    n_odd = odd.count()
    if not n_odd:
        placed = stage(_placed(rows, version), "placed")
        found = placed.join(_chain(placed), ["file", "at"], "left_semi").select("file", "at", *carried)
    else:
        texts = _pieces(spark, path, version)
        if n_odd <= MOST_NAMES:  # the names of few files let Spark skip the others
            texts = texts.where(F.col("file").isin([r["file"] for r in odd.collect()]))
        else:
            texts = texts.join(odd, "file", "left_semi")
        texts = stage(texts, "odd-texts")
        again = _with_payload(_parsed(texts), block, keep_payload).select(*places, *carried)
        placed = stage(_placed(rows.join(odd, "file", "left_anti").unionByName(again), version), "placed")
        chain = stage(_chain(placed), "chain")
        on = placed.join(chain, ["file", "at"], "left_semi").select("file", "at", "complete", *carried)
        pieces = _joined_pieces(placed.join(odd, "file", "left_semi"), chain, texts, version)
        broken = on.where(~F.col("complete")).select("file", "at", *PARSED).join(pieces, ["file", "at"])
        broken = _with_payload(broken, F.col("block_text"), keep_payload)
        found = on.where("complete").select("file", "at", *carried).unionByName(broken.select("file", "at", *carried))
    return found.select(
        "file", "at", "record_type", _page(F.col("urn"), id_type).alias("page_id"), _page(F.col("refers"), id_type).alias("refers_to"),
        *PAYLOAD, *(["payload"] if keep_payload else []),
    )


def digest(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, dict(pages.dtypes)["page_id"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
g AS (SELECT body, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN kept IS NULL OR page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body
"""

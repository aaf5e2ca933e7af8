"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Archives are read in byte ranges: the record mark is the line separator of Spark's text source, so any file can be split anywhere and
any store Spark reads will do. Every mark is a candidate record, and a payload may hold marks too. Each task emits, for the candidates
of its range, where the record would end and the next begin (its successor). Within a range, pointer jumping leads each candidate to
the first successor beyond the range; between ranges, pointer jumping from the file's start finds the one entry of each range; within
the ranges again, the chain from the entry marks the records. What it doesn't reach is payload.

Defined cases: a null payload is empty; a null url is an empty target; control characters in a url are percent-encoded; a null page id
is left out of the header and read back as null; of equal payloads those with the smallest page id are responses, whatever repeats
that id is a response too, and null ids come last (all are responses if no id is known); an archive that doesn't begin with a mark has
no records; a record that runs beyond its file's end, and what follows a broken chain, is no record; an empty table gives an empty
archive and an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingloom.plans.stages import materialize

# Fixed values of the format
MARK = "WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 160 bits given as 40 hexadecimal digits: five digits make four letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE) -> None:
    """One archive a task. Of equal payloads of at least ``least`` bytes one is a response, the others revisits of it."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    base = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn("n", F.octet_length("body").cast("long")).withColumn("hex", F.sha1(F.col("body").cast("binary")))
    # groups of copies, one small row each: written once, so that the join below knows their size
    copies = materialize(base.where(F.col("n") >= least).groupBy(F.col("hex").alias("chex"), F.col("n").alias("cn")).agg(F.min("page").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1).select("chex", "cn", "first"))
    joined = base.join(copies, (F.col("hex") == F.col("chex")) & (F.col("n") == F.col("cn")), "left")
    response = F.col("first").isNull() | F.coalesce(F.col("page") == F.col("first"), F.lit(False))
    digest = base32_of_hex(F.col("hex"))
    # percent-encode what could end a header line
    target = F.coalesce(F.col("url"), F.lit(""))
    for c in ("\r", "\n", "\t", " "):
        target = F.replace(target, F.lit(c), F.lit(f"%{ord(c):02X}"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MARK),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _record_id(F.col("page"), digest)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(F.col("page").isNotNull(), line("X-Page-Id", F.col("page").cast("string"))).otherwise(F.lit("")),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", _record_id(F.col("first"), digest)), line("X-Refers-To-Page", F.col("first").cast("string")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("n").cast("string")).otherwise(F.lit("0"))),
        F.lit("\r\n"),
    )
    # the text sink ends each row with the separator: the last byte of the record
    joined.select(F.concat(head, F.when(response, F.col("body")).otherwise(F.lit("")), F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").mode("errorifexists").text(folder)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1), F.lit(""))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between marks: (file, block, at, value); ``at`` rises along a block."""
    return spark.read.option("lineSep", MARK).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _ends(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The block's candidates by offset, and the place of each one's successor among them (-1: not here)."""
    pdf = pdf.sort_values("off", kind="stable").reset_index(drop=True)
    off, succ = pdf["off"].to_numpy(), pdf["succ"].to_numpy()
    at = np.searchsorted(off, succ)
    inside = (succ >= 0) & (at < len(off))
    inside[inside] = off[at[inside]] == succ[inside]
    return pdf, np.where(inside, at, -1)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, following = _ends(pdf)
    to = np.where(following >= 0, following, np.arange(len(pdf)))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "off": pdf["off"], "exit": pdf["succ"].to_numpy()[to]})


def _marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which candidates the chain from the block's entry reaches."""
    pdf, following = _ends(pdf)
    reached = np.zeros(len(pdf), bool)
    i, nxt = (int(np.argmax(pdf["entry"].to_numpy())) if pdf["entry"].any() else -1), following.tolist()
    valid = pdf["succ"].to_numpy() >= 0
    while i >= 0 and valid[i]:
        reached[i] = True
        i = nxt[i]
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "off": pdf["off"], "reached": reached})


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all archives in ``folder``: file, offset, record_type, target_uri, page_id, payload_bytes, payload_digest,
    refers_to, intact (a response's digest is computed from its payload and equals the header's), and the payload if asked for."""
    value = F.col("value")
    head = F.substring_index(value, "\r\n\r\n", 1)
    seen = _segments(spark, folder).withColumn("len", F.octet_length(value).cast("long")).withColumn("head", head).withColumn("hlen", F.octet_length("head").cast("long"))
    size = _field(F.col("head"), "Content-Length").try_cast("long")
    seen = seen.withColumn("clen", F.when((F.col("hlen") < F.col("len")) & (size >= 0), size))
    whole = F.col("len") >= F.col("hlen") + F.col("clen") + 8
    body = F.substring(value.cast("binary"), (F.col("hlen") + 5).cast("int"), F.col("clen").cast("int"))
    light = seen.select(
        "file", "block", "at", "len", "hlen", "clen", F.sha2(value.cast("binary"), 256).alias("seg"), F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, F.sha1(body)).alias("sha"),
        _field(F.col("head"), "WARC-Type").alias("kind"), _field(F.col("head"), "WARC-Target-URI").alias("uri"), _field(F.col("head"), "X-Page-Id").alias("page"),
        _field(F.col("head"), "X-Payload-Length").alias("plen"), _field(F.col("head"), "WARC-Payload-Digest").alias("digest"), _field(F.col("head"), "X-Refers-To-Page").alias("refers"))
    light = materialize(light)
    # offsets: running sums within a range, over the sums of the ranges before it
    step = F.col("len") + len(MARK)
    in_block = Window.partitionBy("file", "block").orderBy("at")
    blocks = light.groupBy(F.col("file").alias("bfile"), F.col("block").alias("bblock")).agg(F.sum(step).alias("span"))
    by_file = Window.partitionBy("bfile").orderBy("bblock")
    blocks = materialize(blocks.withColumn("before", F.sum("span").over(by_file) - F.col("span")).withColumn("fsize", F.sum("span").over(Window.partitionBy("bfile")) - len(MARK)))
    start = F.col("before") + F.sum(step).over(in_block) - step
    placed = light.join(blocks.select("bfile", "bblock", "before", "fsize"), (F.col("file") == F.col("bfile")) & (F.col("block") == F.col("bblock"))).withColumn("start", start)
    end = F.col("start") + F.col("hlen") + F.col("clen") + 8
    succ = F.when((end <= F.col("fsize")) & (F.col("start") > 0), end).otherwise(F.lit(-1))
    placed = materialize(placed.withColumn("succ", F.coalesce(succ, F.lit(-1))).withColumn("off", F.col("start") - len(MARK)).drop("bfile", "bblock", "before", "at"))
    cand = placed.where(F.col("off") >= 0)
    exits = materialize(cand.select("file", "block", "off", "succ").groupBy("file", "block").applyInPandas(_exits, "file string, block long, off long, exit long"))
    entries = exits.where(F.col("off") == 0).select("file", "off")
    # from range to range; a file of b ranges needs log2(b) rounds
    most = blocks.groupBy("bfile").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if most > 1:
        doors = exits.select("file", F.col("exit").alias("off")).distinct().union(entries).distinct()
        jumps = materialize(exits.join(doors, ["file", "off"], "left_semi").select("file", "off", "exit"))
        for _ in range(int(most).bit_length()):
            onward = entries.join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
            entries = materialize(entries.union(onward).distinct())
            to = jumps.select("file", F.col("off").alias("exit"), F.col("exit").alias("onward"))
            jumps = materialize(jumps.join(to, ["file", "exit"]).select("file", "off", F.col("onward").alias("exit")))
    flagged = cand.select("file", "block", "off", "succ").join(entries.withColumn("hit", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("hit", F.lit(False)))
    marks = flagged.select("file", "block", "off", "succ", "entry").groupBy("file", "block").applyInPandas(_marks, "file string, block long, off long, reached boolean")
    marks = materialize(marks)
    reached = marks.where("reached").select(F.col("file").alias("f"), F.col("off").alias("o"))
    records = materialize(cand.join(reached, (F.col("file") == F.col("f")) & (F.col("off") == F.col("o"))).drop("f", "o"))
    if payload or records.where(~F.col("whole")).limit(1).count():
        records = _with_payload(spark, folder, marks, cand, records if payload else records.where(~F.col("whole")), None if payload else records.where("whole"))
    else:
        records = records.withColumn("payload", F.lit(None).cast("binary"))
    sha = base32_of_hex(F.col("sha"))
    revisit = F.col("kind") == "revisit"
    told = F.regexp_replace("digest", "^sha1:", "")
    out = records.select(
        "file", F.col("off").alias("offset"), F.col("kind").alias("record_type"), F.col("uri").alias("target_uri"), F.col("page").try_cast("long").alias("page_id"),
        F.when(revisit, F.col("plen").try_cast("long")).otherwise(F.col("clen")).alias("payload_bytes"), F.when(revisit, told).otherwise(sha).alias("payload_digest"),
        F.col("refers").try_cast("long").alias("refers_to"), F.coalesce(revisit | (told == sha), F.lit(False)).alias("intact"), "payload")
    return out if payload else out.drop("payload")


def _with_payload(spark: SparkSession, folder: str, marks: DataFrame, cand: DataFrame, wanted: DataFrame, rest: DataFrame | None) -> DataFrame:
    """Put together the payloads of ``wanted`` from the segments between each record and the next one that the chain reaches.

    The first reading decides which segments belong to a record. The archives are read again for their bytes only, which are found by
    their digest and not by their place: the second reading may cut the files into other ranges.
    """
    last = marks.where("reached").groupBy("file", "block").agg(F.max("off").alias("last"))
    every = marks.select("file", "block").distinct().join(last, ["file", "block"], "left")
    carried = every.withColumn("carry", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("file").alias("cf"), F.col("block").alias("cb"), "carry")
    own = F.last(F.when(F.col("reached"), F.col("off")), True).over(Window.partitionBy("file", "block").orderBy("off"))
    owned = marks.withColumn("own", own).join(carried, (F.col("file") == F.col("cf")) & (F.col("block") == F.col("cb")), "left").select("file", "off", F.coalesce("own", "carry").alias("owner"))
    owned = owned.join(wanted.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi")
    parts = materialize(owned.join(cand.select("file", "off", "seg"), ["file", "off"]))
    needed = parts.select(F.col("seg").alias("s")).distinct()
    texts = _segments(spark, folder).select(F.sha2(F.col("value").cast("binary"), 256).alias("s"), "value").join(needed, "s", "left_semi").groupBy("s").agg(F.first("value").alias("value"))
    joined = parts.join(texts, F.col("seg") == F.col("s")).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", F.col("value").cast("binary").alias("v")))).alias("vs"))
    mark = F.lit(MARK).cast("binary")
    glued = F.aggregate("vs", F.lit(None).cast("binary"), lambda acc, v: F.when(acc.isNull(), v["v"]).otherwise(F.concat(acc, mark, v["v"])))
    bodies = joined.select("file", F.col("owner").alias("off"), glued.alias("bytes"))
    out = wanted.join(bodies, ["file", "off"]).withColumn("payload", F.substring("bytes", (F.col("hlen") + 5).cast("int"), F.col("clen").cast("int"))).withColumn("sha", F.sha1("payload")).drop("bytes")
    return out if rest is None else out.unionByName(rest.withColumn("payload", F.lit(None).cast("binary")))


def report(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to ``folder`` and tell what its records say when read back."""
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")

"""Text streams: lines of chunked logs, windows, search, tails.

A stream's chunks are ordered by (step, metric, tag). A line is completed by, and belongs to, the chunk that holds its
newline; unterminated text at the end is a last line of the last chunk that has any text. Line numbers come from counts
of newlines for each chunk: a prefix sum over chunks (small rows, no text), so a window reads the text of few chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import dealt, last_before, place, running, undealt
from ..plans.scratch import checkpointed

STREAM = ["project_id", "run_id"]
ORDER = ["step", "metric_name", "tag"]
MAX_LINES, MAX_METRICS, MAX_BYTES = 2000, 256, 8 << 20
MAX_SEARCH_BYTES = 512


def normalized(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """newlines, whether there is text, whether it ends in a newline, bytes: of each chunk, without its text."""
    t = normalized(F.col("text_data"))
    return chunks.select(*STREAM, *ORDER, F.regexp_count(t, F.lit("\n")).cast("long").alias("newlines"), (F.length(t) > 0).alias("has_text"), t.endswith("\n").alias("closed"), F.octet_length(t).alias("bytes"))


def placed(index: DataFrame) -> DataFrame:
    """Adds ``lines_before``: newlines of earlier chunks of the stream, scanned in blocks of chunks."""
    out = running(dealt(index, STREAM, ORDER), STREAM, {"lines_before": ("sum", F.col("newlines"))}, before=True)
    return undealt(out).withColumn("lines_before", F.coalesce("lines_before", F.lit(0).cast("long")))


def totals(index: DataFrame) -> DataFrame:
    """total_lines and first_step of each stream; an unterminated end counts as a line."""
    last = F.max(F.when(F.col("has_text"), F.struct(*ORDER, "closed"))).alias("last")
    agg = index.groupBy(*STREAM).agg(F.sum("newlines").alias("n"), last, F.min(F.when(F.col("has_text"), F.col("step"))).alias("first_step"))
    tail = F.when(F.col("last").isNotNull() & ~F.col("last.closed"), 1).otherwise(0)
    return agg.select(*STREAM, (F.col("n") + tail).alias("total_lines"), "first_step")


def _pieces(chunks: DataFrame, where: DataFrame) -> DataFrame:
    """Pieces between newlines of the chunks in ``where`` (index rows with lines_before and newlines), with the number of the line
    they belong to; a chunk's end behind its last newline counts only if there is any."""
    extra = [c for c in where.columns if c not in (*STREAM, *ORDER, "lines_before", "newlines")]
    slim = chunks.select(*STREAM, *ORDER, normalized(F.col("text_data")).alias("_t"))
    parts = slim.join(where, [*STREAM, *ORDER]).select(*STREAM, *ORDER, *extra, "lines_before", "newlines", F.posexplode(F.split("_t", "\n", -1)).alias("i", "part"))
    return parts.where("i < newlines OR part <> ''").select(*STREAM, *ORDER, *extra, (F.col("lines_before") + F.col("i")).alias("line_index"), "part")


def lines(chunks: DataFrame) -> DataFrame:
    """line_index, line and the (step, metric, tag) of the chunk that completes it.

    Lines inside a chunk stay where its text is; only what stands before its first and behind its last newline meets other
    chunks' pieces."""
    where = placed(chunk_index(chunks)).select(*STREAM, *ORDER, "lines_before", "newlines")
    cut = chunks.select(*STREAM, *ORDER, F.split(normalized(F.col("text_data")), "\n", -1).alias("p")).join(where, [*STREAM, *ORDER])
    inner = cut.where("newlines > 1").select(*STREAM, *ORDER, "lines_before", F.posexplode(F.slice("p", F.lit(2), (F.col("newlines") - 1).cast("int"))).alias("i", "line"))
    inner = inner.select(*STREAM, (F.col("lines_before") + 1 + F.col("i")).alias("line_index"), "line", *ORDER)
    ends = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.get("p", F.lit(0)).alias("part")), F.struct(F.col("newlines").alias("i"), F.when(F.col("newlines") > 0, F.element_at("p", -1)).alias("part")))
    fragments = cut.select(*STREAM, *ORDER, "lines_before", "newlines", F.inline(ends)).where("part IS NOT NULL AND (i < newlines OR part <> '')")
    return inner.unionByName(_joined(fragments.select(*STREAM, *ORDER, (F.col("lines_before") + F.col("i")).alias("line_index"), "part")))


def _joined(fragments: DataFrame) -> DataFrame:
    """Lines of fragments, put together in order."""
    g = fragments.groupBy(*STREAM, "line_index").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "part"))).alias("f"))
    owner = F.element_at("f", -1)
    text = F.array_join(F.transform("f", lambda x: x.part), "")
    return g.select(*STREAM, "line_index", text.alias("line"), *[owner[c].alias(c) for c in ORDER])


def window(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """Lines offset .. offset + limit of each stream: the index finds the chunks, and only their text is split. A limit outside
    1 to 2000 is taken as the nearest of these; a stream of more than 256 metrics and a window of more than 8 MiB are errors."""
    limit = min(max(limit, 1), MAX_LINES)
    wide = chunks.select(*STREAM, "metric_name").distinct().groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_METRICS).first()
    if wide:
        raise ValueError(f"{wide.run_id} has {wide.n} metrics, {MAX_METRICS} at most make a window")
    where = placed(chunk_index(chunks)).where((F.col("lines_before") < offset + limit) & (F.col("lines_before") + F.col("newlines") >= offset)).select(*STREAM, *ORDER, "lines_before", "newlines")
    found = _joined(_pieces(chunks, where).where(F.col("line_index").between(offset, offset + limit - 1)))
    held = F.sum(F.octet_length("line")).over(Window.partitionBy(*STREAM))  # of at most 2000 lines
    checked = F.when(held > MAX_BYTES, F.raise_error(F.concat(F.lit("a window passes 8 MiB: "), "run_id")).cast("string")).otherwise(F.col("line"))
    return found.withColumn("line", checked).orderBy(*STREAM, "line_index")


def tail(chunks: DataFrame, n: int) -> DataFrame:
    """The last n lines of each stream: the index finds the chunks that hold them, and only their text is split."""
    index = chunk_index(chunks)
    wanted = totals(index).select(*STREAM, (F.col("total_lines") - n).alias("_from"))
    where = placed(index).join(wanted, STREAM).where(F.col("lines_before") + F.col("newlines") >= F.col("_from"))
    return _joined(_pieces(chunks, where.select(*STREAM, *ORDER, "lines_before", "newlines", "_from")).where(F.col("line_index") >= F.col("_from"))).orderBy(*STREAM, "line_index")


#: Candidates, boundary lines that may match, up to which their places are broadcast; more are joined by a shuffle.
_BROADCAST_ROWS = 100_000


def search(chunks: DataFrame, text: str) -> DataFrame:
    """Matching whole lines, case-insensitively (a text of at most 512 bytes); ``match_index`` counts matches in stream order.

    Each chunk is searched where it lies and leaves a small row: how many lines it has, its matching inner lines, and of its
    pieces before the first and behind the last newline whether they match and the few characters at their ends by which a
    match may span pieces. Only boundary lines that may match have their text fetched, and are tested whole."""
    if len(text.encode()) > MAX_SEARCH_BYTES:
        raise ValueError(f"a search is limited to {MAX_SEARCH_BYTES} bytes")
    low = text.lower()
    # a lower-case sigma depends on what follows, which a piece may lack: candidates take both forms for one
    folded = lambda c: F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))
    may = lambda c: F.contains(folded(c), F.lit(low.replace("ς", "σ")))
    matches = lambda c: F.contains(F.lower(c), F.lit(low))
    reach = len(low)  # lower-casing may shorten a text by a part of its characters only, so this covers len - 1 of them
    edge = lambda c: F.when(F.length(c) <= 4 * reach, c).otherwise(F.concat(F.left(c, F.lit(2 * reach)), F.lit("\n"), F.right(c, F.lit(2 * reach))))
    t = chunks.select(*STREAM, *ORDER, normalized(F.col("text_data")).alias("t"))
    t = t.select("*", F.regexp_count("t", F.lit("\n")).cast("long").alias("newlines"))
    inner = F.transform(F.slice(F.split("t", "\n", -1), F.lit(2), F.greatest(F.col("newlines") - 1, F.lit(0)).cast("int")), lambda x, i: F.struct((i + 1).cast("long").alias("i"), x.alias("line")))
    hits = F.when(may(F.col("t")) & (F.col("newlines") > 1), F.filter(inner, lambda s: matches(s["line"])))
    piece = lambda c: F.struct(edge(c).alias("edge"), may(c).alias("hit"), (c == "").alias("empty"))
    first, last = F.substring_index("t", "\n", 1), F.substring_index("t", "\n", -1)
    small = t.select(*STREAM, *ORDER, "newlines", hits.alias("hits"), piece(first).alias("first"), F.when(F.col("newlines") > 0, piece(last)).alias("last"))
    small = checkpointed(placed(small))
    cols = [*STREAM, "line_index", "line", *ORDER]
    inside = small.where("size(hits) > 0").select(*STREAM, *ORDER, "lines_before", F.inline("hits")).withColumn("line_index", F.col("lines_before") + F.col("i")).select(*cols)
    ends = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("first").alias("p")), F.struct(F.col("newlines").alias("i"), F.col("last").alias("p")))
    pieces = small.select(*STREAM, *ORDER, "lines_before", "newlines", F.inline(ends)).where("p IS NOT NULL AND (i < newlines OR NOT p.empty)")
    pieces = pieces.select(*STREAM, *ORDER, (F.col("lines_before") + F.col("i")).alias("line_index"), F.col("i"), "p")
    g = pieces.groupBy(*STREAM, "line_index").agg(F.bool_or("p.hit").alias("hit"), F.sort_array(F.collect_list(F.struct(*ORDER, "i", "p.edge"))).alias("f"))
    wanted = checkpointed(g.where(F.col("hit") | may(F.array_join(F.transform("f", lambda x: x.edge), ""))).select(*STREAM, "line_index", F.inline(F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in ORDER], x["i"].alias("i"))))))
    of = F.broadcast(wanted) if wanted.count() <= _BROADCAST_ROWS else wanted
    part = F.when(F.col("i") == 0, F.substring_index("t", "\n", 1)).otherwise(F.substring_index("t", "\n", -1))
    fetched = chunks.select(*STREAM, *ORDER, normalized(F.col("text_data")).alias("t")).join(of, [*STREAM, *ORDER]).select(*STREAM, *ORDER, "line_index", part.alias("part"))
    across = _joined(fetched).where(matches(F.col("line"))).select(*cols)
    return place(inside.unionAll(across), STREAM, ["line_index"], "match_index")


def pack_lines(rows: DataFrame, by: list[str], order: list[str], cap: int = 64_000) -> DataFrame:
    """Console lines -> chunks, greedily: a chunk takes lines while its stream stays the same and its characters, terminators
    included, stay within ``cap``; a longer line is a chunk of its own. A chunk's time is its first line's, else that of the
    chunk before it, else 0.

    Where a stretch of one stream fits the cap it is a chunk. In longer ones every line's successor, the first line of the next
    chunk if a chunk began with it, is found in prefix sums, and the lines that the first one leads to are marked by doubling:
    a round follows twice as many chunks as the one before it. No step holds a stretch in a task."""
    key, part = [*by, "island"], [*by, "island", "_n"]
    line = F.regexp_replace("line", r"(\r\n|\n)\z", "")
    d = dealt(rows.select(*by, *order, "stream", "timestamp_ms", line.alias("_line")), by, order)
    d = last_before(d, by, {"_was": F.struct(F.col("stream").alias("s"))})
    fresh = F.when(F.col("_was").isNull() | ~F.col("_was.s").eqNullSafe(F.col("stream")), 1).otherwise(0)
    d = running(d, by, {"island": ("sum", fresh), "_s": ("sum", F.length("_line") + 1), "_n": ("sum", F.lit(1))})
    told = checkpointed(undealt(d).drop("_was").withColumn("_before", F.col("_s") - F.length("_line") - 1))
    stretches = told.groupBy(*key).agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"), (F.max("_s") - F.min("_before")).alias("_chars"))
    long = told.select(*part, "_s", "_before").join(stretches.where(F.col("_chars") > cap).select(*key, "_last"), key)
    starts = stretches.select(*key, F.col("_first").alias("_n"))
    if not long.isEmpty():
        # the first line whose sum passes that of a full chunk; at equal sums lines come first, so they don't count
        sums = long.select(*part, F.col("_s").alias("_v"), F.lit(0).alias("_asks"), F.col("_n").alias("_to"), "_last")
        asks = long.select(*part, (F.col("_before") + cap).alias("_v"), F.lit(1), F.lit(None).cast("long"), "_last")
        found = last_before(dealt(sums.unionAll(asks), key, ["_v", "_asks", "_n"]), key, {"_next": F.col("_to")}, backwards=True).where("_asks = 1")
        leads = checkpointed(found.select(*part, F.greatest("_next", F.col("_n") + 1).alias("_to"), "_last").where("_next IS NOT NULL AND _to <= _last").drop("_last"))
        marked = checkpointed(stretches.where(F.col("_chars") > cap).select(*key, F.col("_first").alias("_n")))
        while not leads.isEmpty():
            marked = checkpointed(marked.unionAll(marked.join(leads, part).select(*key, F.col("_to").alias("_n"))).distinct())
            leads = checkpointed(leads.join(leads.select(*key, F.col("_n").alias("_to"), F.col("_to").alias("_far")), [*key, "_to"]).select(*key, "_n", F.col("_far").alias("_to")))
        starts = starts.unionAll(marked).distinct()
    heads = told.join(starts.withColumn("_head", F.lit(True)), part, "left")
    cut = last_before(dealt(heads, by, ["_n"]), by, {"_start": F.when(F.col("_head"), F.col("_n"))}, include=True)
    # a chunk's lines are at most the cap's characters, or one line
    packed = cut.groupBy(*key, "_start").agg(
        F.min("stream").alias("stream"), F.min_by("timestamp_ms", "_n").alias("_own"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("_n", "_line"))).alias("_l")
    )
    timed = running(last_before(dealt(packed, by, ["_start"]), by, {"_time": F.col("_own")}, include=True), by, {"_c": ("sum", F.lit(1))})
    firsts = timed.groupBy(*key).agg(F.min("_c").alias("_c0"))
    text = F.concat(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n"), F.lit("\n"))
    return timed.join(firsts, key).select(*key, (F.col("_c") - F.col("_c0")).alias("part"), "stream", F.coalesce("_time", F.lit(0)).alias("timestamp_ms"), "n_lines", text.alias("text_data"))


def cap_lines(rows: DataFrame, by: list[str], order: list[str], limit: int, note: str = "[first {} console lines omitted]") -> DataFrame:
    """Console lines whose characters, terminators included, pass ``limit``: the oldest go (the last line stays), and a line that
    tells how many stands in front, with the first kept line's time."""
    line = F.regexp_replace("line", r"(\r\n|\n)\z", "")
    later = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    told = rows.withColumn("line", line).withColumns({"_after": F.sum(F.length("line") + 1).over(later.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(later)})
    told = told.withColumn("_keep", (F.col("_after") <= limit) | (F.col("_nth") == 1))
    dropped = told.groupBy(*by).agg(F.count_if(~F.col("_keep")).alias("_n"), F.min_by(F.struct(*rows.columns), F.when(F.col("_keep"), F.struct(*order))).alias("_first")).where("_n > 0")
    before, after = (F.lit(x) for x in note.split("{}"))
    first = dropped.select("_n", *[F.col(f"_first.{c}").alias(c) for c in rows.columns]).withColumn("line", F.concat(before, F.col("_n").cast("string"), after))
    kept = told.where("_keep").select(*rows.columns, F.lit(1).alias("part"))
    return first.withColumn("stream", F.lit("info")).select(*rows.columns, F.lit(0).alias("part")).unionAll(kept)


def cap_file(raw: Column, most_bytes: int, note: str = "[first {} bytes of output.log omitted]") -> Column:
    """Text of a log file's last ``most_bytes`` bytes, bad UTF-8 replaced; a line in front tells how many were left out."""
    gone = F.octet_length(raw) - most_bytes
    kept = F.make_valid_utf8(F.substring(raw, F.greatest(gone, F.lit(0)) + 1, F.octet_length(raw)).cast("string"))
    before, after = (F.lit(x) for x in note.split("{}"))
    return F.when(gone > 0, F.concat(before, gone.cast("string"), after, F.lit("\n"), kept)).otherwise(kept)


def cut_file(files: DataFrame, cap: int = 64_000) -> DataFrame:
    """Whole log texts (path, text) -> chunks of at most ``cap`` characters (path, part, text_data), each cut behind its last
    newline that isn't its first character, else at the cap; what is left within the cap is the last chunk, uncut."""
    pattern = rf"(?s)(?:.{{1,{cap}}}\z|.{{1,{cap - 1}}}\n|.{{1,{cap}}})"
    return files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("part", "text_data"))

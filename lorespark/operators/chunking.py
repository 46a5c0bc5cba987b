"""Segments of a text and their packing into overlapping chunks, as folds over arrays inside one row: no shuffle,
whatever the number of documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.config import SETTINGS
from lorespark.functions import text as T

NONE = "CAST(array() AS array<string>)"
PARAGRAPH = "\\n\\n"


def segments(x: str) -> str:
    """Headings and bullets alone, other lines joined until a blank one. Lines hold no line end, so line ends mark the
    cuts: one split does it, in time that follows the length of the text."""
    marked = f"IF(l = '', '\\n', IF({T.is_heading('l')} OR {T.is_bullet('l')}, concat('\\n', l, '\\n'), l))"
    joined = f"array_join(transform(split({T.normalized(x)}, '\\n', -1), l -> {marked}), ' ')"
    return f"filter(split({joined}, ' *\\n[ \\n]*', -1), sx -> sx <> '')"


def long_pieces(x: str, size: int, overlap: int) -> str:
    """A segment that is too long: packed sentences; a sentence too long by itself is cut into windows if nothing
    is being packed, and else goes out whole."""
    candidate = f"IF(b.cur = '', ls, {T.strip("concat(b.cur, ' ', ls)")})"
    step = f"""CASE WHEN length(cd) <= {size} THEN named_struct('o', b.o, 'cur', cd)
        WHEN b.cur <> '' THEN named_struct('o', array_append(b.o, b.cur), 'cur', ls)
        ELSE named_struct('o', concat(b.o, {T.windows('ls', size, overlap)}), 'cur', '') END"""
    step = T.let("cd", candidate, step)
    packed = f"aggregate(sn, named_struct('o', {NONE}, 'cur', ''), (b, ls) -> {step}, b -> IF(b.cur = '', b.o, array_append(b.o, b.cur)))"
    return T.let("sn", T.sentences(x), f"IF(size(sn) <= 1, {T.windows(x, size, overlap)}, {packed})")


def overlap_seed(x: str, overlap: int) -> str:
    """The last segments that fit the overlap, the very last one always."""
    if not overlap:
        return NONE
    step = f"IF(c.stop OR (size(c.o) > 0 AND c.n + length(os) + 2 > {overlap}), named_struct('o', c.o, 'n', c.n, 'stop', true), named_struct('o', concat(array(os), c.o), 'n', c.n + length(os) + 2, 'stop', false))"
    return f"aggregate(reverse({x}), named_struct('o', {NONE}, 'n', 0, 'stop', false), (c, os) -> {step}, c -> c.o)"


def chunks(x: str, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> str:
    """Segments packed up to size, each chunk beginning with the end of the one before."""
    emitted = f"IF({T.meaningful('p.cur')}, array_append(p.o, p.cur), p.o)"
    seeded = f"array_append({overlap_seed('p.segs', overlap)}, sg)"
    step = f"""CASE WHEN length(sg) > {size} THEN named_struct('o', concat({emitted}, filter({long_pieces('sg', size, overlap)}, lp -> {T.meaningful('lp')})), 'segs', {NONE}, 'cur', '')
        WHEN size(p.segs) = 0 THEN named_struct('o', p.o, 'segs', array(sg), 'cur', sg)
        WHEN length(p.cur) + 2 + length(sg) <= {size} THEN named_struct('o', p.o, 'segs', array_append(p.segs, sg), 'cur', concat(p.cur, '\\n\\n', sg))
        ELSE {T.let('sd', seeded, f"named_struct('o', {emitted}, 'segs', sd, 'cur', array_join(sd, '{PARAGRAPH}'))")} END"""
    return f"aggregate({segments(x)}, named_struct('o', {NONE}, 'segs', {NONE}, 'cur', ''), (p, sg) -> {step}, p -> {emitted})"


def chunk_documents(docs: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """docs (doc_id, title, source_path, text): one row a chunk, with chunk_id, order from 1 and section_heading; other
    columns of docs go with every chunk. A text without chunks is one chunk if it is a brief but meaningful one, and
    else none. Chunks of a PDF page (doc_type .pdf) have its page_heading as section heading; others find theirs
    in the chunk, and fall back on page_heading where there is one."""
    alone = T.let("wt", T.normalized("text"), f"IF({T.brief('wt')}, array(wt), {NONE})")
    parts = T.let("ps", chunks("text", size, overlap), f"IF(size(ps) > 0, ps, {alone})")
    more = [c for c in docs.columns if c not in ("doc_id", "title", "source_path", "text")]
    # the outer form, as for the other one the optimizer adds a filter that works the chunks out again
    rows = docs.select("doc_id", "title", "source_path", *more, F.posexplode_outer(F.expr(parts)).alias("pos", "text")).filter("pos IS NOT NULL")
    page = "coalesce(page_heading, '')" if "page_heading" in more else "''"
    heading = T.section_heading("text", page)
    heading = f"IF(doc_type = '.pdf', {page}, {heading})" if "doc_type" in more else heading
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-chunk-"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), "doc_id", "title", "source_path",
        (F.col("pos") + 1).alias("order"), "text", F.expr(heading).alias("section_heading"), *more,
    )

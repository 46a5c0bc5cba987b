"""What a page shows of texts, files and times, as SQL expressions over strings of Spark SQL. Lengths count code points."""

from lorespark.functions import text as T

#: Fixed value: white space as browsers know it.
BLANK = r"[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+\\\\z', '')"


def truncated(x: str, limit: int = 88) -> str:
    """White space collapsed; what is longer than the limit ends with a mark."""
    return T.let("tx", trimmed(f"regexp_replace(coalesce({x}, ''), '{BLANK}+', ' ')"), f"IF(length(tx) <= {limit}, tx, concat(substring(tx, 1, {limit - 1}), '…'))")


def markdown_text(x: str) -> str:
    """Without &nbsp; and tags."""
    return f"regexp_replace(replace({x}, '&nbsp;', ' '), '</?[A-Za-z][^>]*>', '')"


def source_snippet(x: str) -> str:
    """markdown_text without leading lines that are blank or hold a closing bracket alone."""
    return trimmed(f"regexp_replace(replace({markdown_text(x)}, '\\r\\n', '\\n'), '^(?:{BLANK}*(?:\\\\\\\\?\\\\])?{BLANK}*(?:\\n|\\\\z))+', '')")


def file_size(n: str) -> str:
    """A whole number of bytes as B, KB, MB or GB: a decimal below 10 units, none from there on or for bytes."""
    unit = lambda u: f"IF({n} >= {10 * u}, CAST((2 * {n} + {u}) DIV {2 * u} AS string), concat((20 * {n} + {u}) DIV {2 * u} DIV 10, '.', (20 * {n} + {u}) DIV {2 * u} % 10))"
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return f"CASE WHEN {n} IS NULL OR {n} <= 0 THEN '0 B' WHEN {n} < {kb} THEN concat({n}, ' B') WHEN {n} < {mb} THEN concat({unit(kb)}, ' KB') WHEN {n} < {gb} THEN concat({unit(mb)}, ' MB') ELSE concat({unit(gb)}, ' GB') END"


def time_label(x: str) -> str:
    """A time to the minute; nothing for none."""
    return f"coalesce(date_format({x}, 'yyyy/MM/dd HH:mm'), '')"


def source_link(path: str, page: str) -> str:
    """The address of a source, with the page of a PDF."""
    coded = f"replace(url_encode({path}), '+', '%20')"
    for mark, code in (("!", "%21"), ("\\'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        coded = f"replace({coded}, '{code}', '{mark}')"
    return f"IF(coalesce({path}, '') = '', '', concat('/api/source?path=', {coded}, IF(coalesce({page}, 0) <> 0 AND endswith(lower({path}), '.pdf'), concat('#page=', {page}), '')))"


def base_name(x: str) -> str:
    """The last part of a path; none for a path of dots and slashes alone."""
    return T.let("bn", f"regexp_extract(regexp_replace({x}, '(?:/+\\\\.?)+\\\\z', ''), '[^/]*\\\\z', 0)", "IF(bn = '.', '', bn)")


def suffix(x: str) -> str:
    """From the last dot of a name, unless it begins or ends the name."""
    return f"regexp_extract({x}, '(?s)^.+(\\\\.[^.]+)\\\\z', 1)"


def upload_name(x: str) -> str:
    """A safe file name: runs of characters other than digits, letters (ASCII, Chinese), white space and ._()- become
    one _; a name of which nothing is left has a default one."""
    name = f"replace({base_name(T.strip(f"coalesce({x}, '')"))}, '\\u0000', '')"
    stem = T.strip(f"substring(un, 1, length(un) - length({suffix('un')}))")
    safe = rf"trim(BOTH ' ._' FROM regexp_replace({stem}, '[^0-9A-Za-z一-鿿._()\\-\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', '_'))"
    return T.let("un", name, f"concat(coalesce(nullif({safe}, ''), 'course_material'), lower({suffix('un')}))")

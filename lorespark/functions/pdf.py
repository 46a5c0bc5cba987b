"""Cleaning of text extracted from PDF pages, as SQL expressions over strings of Spark SQL."""

from lorespark.functions import text as T

#: Marks of slide headers and footers, compared without white space and in lower case.
MARKERS = (
    "comp5575", "high-dimensionaldatamanagementandanalytics", "departmentofcomputing", "thehongkongpolytechnicuniversity",
    "permissionfromdr", "slidescanbefreelyused", "slidescontributorforlecture",
)
BREAKS = r"\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
DIGITS = r"[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def repaired(x: str) -> str:
    """One space between words; letters that extraction cut off are joined with the word after them, and no space
    stays before a mark. Cut letters in a row are found by looking ahead, so one pass does what repeated passes would."""
    one = T.strip(f"regexp_replace({x}, '{T.SPACE}+', ' ')")
    joined = rf"regexp_replace({one}, '(?U)(?<=\\b[A-Za-z]) (?=(?:[a-z] )*[a-z]{{2,}}\\b)', '')"
    return f"regexp_replace({joined}, ' ([,.;:!?])', '$1')"


def is_noise(x: str, page: str, markers: tuple[str, ...] = MARKERS) -> str:
    """Blank lines, page numbers, links, header marks, and lines of digits without letters."""
    compact = f"lower(regexp_replace({x}, '{T.SPACE}+', ''))"
    marked = " OR ".join(f"contains({compact}, '{m}')" for m in markers) or "false"
    digit = f"({x} RLIKE '{DIGITS}')"
    return (
        f"({x} = '' OR {x} = CAST({page} AS string) OR (length({x}) <= 3 AND {x} RLIKE '(?i)^(?:\\\\p{{Nd}}+|[ivxlcdm]+)\\\\z')"
        f" OR {x} RLIKE '(?i)^(?:\\\\[\\\\p{{Nd}}+\\\\]{T.SPACE}*)?https?://' OR {marked} OR ({digit} AND (length({x}) <= 4 OR NOT {x} RLIKE '\\\\p{{L}}')))"
    )


def is_heading(x: str) -> str:
    return f"(length({x}) <= 90 AND NOT {T.is_bullet(x)} AND NOT {x} RLIKE '^[<\\\\[]|[{T.ENDS}]\\\\z')"


def blocks(x: str, page: str, markers: tuple[str, ...] = MARKERS) -> str:
    """Lines that look like headings alone; bullets and paragraphs with the lines that follow them. Lines hold no
    line end, so line ends mark the cuts."""
    lines = f"filter(transform(split({x}, '{BREAKS}', -1), pl -> {repaired('pl')}), pl -> NOT {is_noise('pl', page, markers)})"
    marked = f"IF({is_heading('pl')}, concat('\\n', pl, '\\n'), IF({T.is_bullet('pl')}, concat('\\n', pl), pl))"
    return f"filter(split(array_join(transform({lines}, pl -> {marked}), ' '), ' *\\\\n[ \\\\n]*', -1), pb -> pb <> '')"


def first_heading(blocks: str) -> str:
    return f"coalesce(try_element_at(filter(slice({blocks}, 1, 4), pb -> {is_heading('pb')}), 1), '')"

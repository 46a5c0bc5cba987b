"""Text expressions. Each takes and returns a string of Spark SQL, so they nest inside higher-order functions."""

from lorespark.config import STOP_BIGRAMS

SPACE = r"[\\s\\x1c-\\x1f\\x85\\p{Z}]"
#: The characters of SPACE.
WHITE = "\\t\\n\\u000b\\u000c\\r\\u001c\\u001d\\u001e\\u001f \\u0085\\u00a0\\u1680" + "".join(f"\\u{c:04x}" for c in range(0x2000, 0x200B)) + "\\u2028\\u2029\\u202f\\u205f\\u3000"
BULLET = r"^(?:[-*•▪◦]|(?:(?U)\\d+(?-U)|[A-Za-z])[.)])" + SPACE + "+"
ENDS = "。？！.?!;；:"
STOPS = ", ".join(f"'{w}'" for w in STOP_BIGRAMS)


def strip(x: str) -> str:
    """Without white space (of any script) at both ends."""
    return f"trim(BOTH '{WHITE}' FROM {x})"


def let(name: str, value: str, body: str) -> str:
    """body, with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def normalized(x: str) -> str:
    """Lines stripped, runs of spaces and of blank lines made one, line ends unified."""
    lines = rf"transform(split(replace({x}, '\r\n', '\n'), '\n', -1), nl -> regexp_replace({strip('nl')}, '[ \\t]{{2,}}', ' '))"
    return strip(rf"regexp_replace(array_join({lines}, '\n'), '\\n{{3,}}', '\n\n')")


def is_bullet(x: str) -> str:
    return f"({x} RLIKE '{BULLET}')"


def is_heading(x: str) -> str:
    """A line with a # in front, or a short one that is no bullet and has no end mark."""
    return f"(startswith({x}, '#') OR (length({x}) <= 90 AND NOT {is_bullet(x)} AND NOT ({x} RLIKE '[{ENDS}]\\\\z')))"


def clean_heading(x: str) -> str:
    """Without # marks, tags, &nbsp; and marks at the ends."""
    bare = rf"regexp_replace(regexp_replace({strip(x)}, '^#{{1,6}}{SPACE}*', ''), '<[^>]+>', '')"
    return rf"regexp_replace(regexp_replace(replace({bare}, '&nbsp;', ' '), '[ \\t]{{2,}}', ' '), '^[ \\-–:：]+|[ \\-–:：]+\\z', '')"


def section_heading(x: str, fallback: str = "''") -> str:
    """The last marked heading, else the last heading-like line, else the fallback, cleaned."""
    lines = rf"filter(transform(filter(transform(split({x}, '\n', -1), hl -> {strip('hl')}), hl -> hl <> ''), hl -> named_struct('s', hl, 'c', {clean_heading('hl')})), hl -> hl.c <> '' AND NOT {is_bullet('hl.c')})"
    marked = "try_element_at(filter(hls, hl -> startswith(hl.s, '#')), -1).c"
    like = f"try_element_at(filter(hls, hl -> NOT startswith(hl.s, '#') AND {is_heading('hl.c')}), -1).c"
    return let("hls", lines, f"coalesce({marked}, {like}, {clean_heading(fallback)})")


def alnum(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ''))"


def meaningful(x: str) -> str:
    return f"(length({strip(x)}) >= 40 AND {alnum(x)} >= greatest(18, length({strip(x)}) DIV 3))"


def brief(x: str) -> str:
    return f"(length({strip(x)}) >= 8 AND {alnum(x)} >= greatest(6, length({strip(x)}) DIV 2))"


def tokens(x: str) -> str:
    """ASCII runs, then bigrams of runs of Chinese characters (a run of one is itself), without stop words."""
    pairs = "flatten(transform(regexp_extract_all(lower(%s), '[一-鿿]+', 0), tr -> IF(length(tr) = 1, array(tr), transform(sequence(1, length(tr) - 1), ti -> substring(tr, ti, 2)))))" % x
    return rf"filter(concat(regexp_extract_all(lower({x}), '[a-z0-9_+\\-]+', 0), {pairs}), tk -> tk NOT IN ({STOPS}))"


def sentences(x: str) -> str:
    """Cut after end marks followed by white space."""
    return rf"filter(transform(split({x}, '(?<=[。！？.!?;；:]){SPACE}+', -1), st -> {strip('st')}), st -> st <> '')"


def answer_sentences(x: str) -> str:
    """Cut right after Chinese end marks and line ends."""
    return rf"filter(transform(split({x}, '(?<=[。！？；\\n])', -1), st -> {strip('st')}), st -> st <> '')"


def windows(x: str, size: int, overlap: int) -> str:
    """Overlapping pieces of a text, from every start."""
    return f"IF(length({x}) = 0, CAST(array() AS array<string>), filter(transform(sequence(0, length({x}) - 1, {max(size - overlap, 1)}), wi -> {strip(f'substring({x}, wi + 1, {size})')}), wi -> wi <> ''))"


def escaped(x: str) -> str:
    """Safe inside HTML, attributes included."""
    return f"""replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""

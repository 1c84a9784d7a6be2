"""Text cleaning and extraction as native Spark expressions (no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.rules import lit_array, sql_any, sql_str

# Java's \s is ASCII only; this class also covers the Unicode spaces.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(chr(n) for n in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# A run of spaces that is not one plain blank: replacing only these by a blank leaves what replacing all runs would.
# The first class turns away all printable ASCII characters at once; whether it met a space is then asked of that one character.
_MAYBE = r"[\t\n\x0B\f\r \u0080-\uffff]"
SPACES = _MAYBE + "(?<=" + WS + ")(?:(?<! )" + WS + "*|(?=" + _MAYBE + ")" + WS + "+)"
# ASCII word boundaries, independent of the JVM's Unicode rules for \b.
B0, B1 = r"(?<!\w)", r"(?!\w)"

# --- fixed values: ordered (pattern, replacement) rules -----------------------
# Consecutive rules are grouped under a guard, a cheap test without which none of the
# group's patterns can match: a required substring, one of several in the lower-cased text
# ("lower:"), "non-ascii", or a regex ("regex:").
PLAINTEXT_RULES = [
    ("<", [
        (r"(?i)<script[\s\S]*?</script>", " "),
        (r"(?i)<style[\s\S]*?</style>", " "),
        (r"<[^>]+>", " "),
    ]),
    ("&", [
        (r"&nbsp;", " "),
        (r"&amp;", "&"),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&#x2F;", "/"),
        (r"&#39;", "'"),
        (r"&quot;", '"'),
        (r"&apos;", "'"),
        (r"&mdash;", " \u2014 "),
        (r"&ndash;", " \u2013 "),
        (r"&ldquo;|&rdquo;", '"'),
        (r"&lsquo;|&rsquo;", "'"),
        (r"&hellip;", "..."),
        (r"&bull;", " "),
        (r"&middot;", " "),
        (r"&#\d+;", " "),
        (r"&[a-zA-Z]+;", " "),
    ]),
    ("non-ascii", [
        (r"[\u00a0\u202f\u2007\u2000-\u200b\u2028\u2029\ufeff]", " "),
        (r"[\u00ad\u200c-\u200f]", ""),
    ]),
    ("$$", [(r"\$\$[\s\S]{0,1200}?\$\$", " ")]),
    ("\\", [
        (r"\\\[[\s\S]{0,1200}?\\\]", " "),
        (r"\\\([\s\S]{0,400}?\\\)", " "),
        (r"\$(?=[^$\n]*\\[a-zA-Z])[^$\n]{0,300}?\$", " "),
        (r"\\(?:textbf|textit|emph|text|mathbf|mathrm|mathit|mathcal|mathbb|mathsf|operatorname"
         r"|hat|tilde|bar|vec)\{([^{}]{0,100})\}", "$1"),
        (r"\\(?:cite|ref|label|footnote|section|subsection|paragraph|caption)\{[^{}]{0,100}\}", " "),
        (r"\\[a-zA-Z]+(?:\[[^\]]{0,50}\])?", " "),
    ]),
    ("regex:[{}]", [(r"(?<!\w)\{|\}(?!\w)", " ")]),
    ("~", [(r"~", " ")]),
    ("`", [
        (r"`{3}[^\n]*\n?", " "),
        (r"`([^`\n]+)`", "$1"),
    ]),
    ("#", [(r"(?m)^#{1,6}" + WS + "+", "")]),
    ("**", [(r"\*{2,3}([^*\n]+)\*{2,3}", "$1")]),
    ("__", [(r"_{2}([^_\n]+)_{2}", "$1")]),
    ("*", [(r"\*([^*\n]+)\*", "$1")]),
    ("](", [
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"!\[[^\]]*\]\([^)]+\)", " "),
    ]),
    ("lower:the post |continue reading|read the full|read more|subscribe |click here|view full|view original|see full|see original", [
        (r"(?i)" + B0 + r"The post .{5,120} appeared first on .{3,80}\." + WS + "*", " "),
        (r"(?i)" + B0 + r"Continue reading\.{0,3}" + WS + "*\u00bb?" + WS + "*", " "),
        (r"(?i)" + B0 + r"Read (the full story|more)\.{0,3}" + WS + "*\u00bb?" + WS + "*", " "),
        (r"(?i)" + B0 + r"Subscribe (to|now).{0,60}\." + WS + "*", " "),
        (r"(?i)" + B0 + r"Click here to .{5,80}\." + WS + "*", " "),
        (r"(?i)" + B0 + r"(View|See) (full|original) (article|post|story).{0,30}\." + WS + "*", " "),
    ]),
    ("non-ascii", [(r"[\u00a9\u00ae\u2122\u00b0]", " ")]),
    (None, [(r"[-=_|*~]{4,}", " ")]),
    ("regex:\t|  ", [(r" [ \t]+|\t[ \t]*", " ")]),
    ("\n\n\n", [(r"\n{3,}", "\n\n")]),
]
TITLE_RULES = [
    ("<", [(r"<[^>]+>", " ")]),
    ("&", [
        (r"&nbsp;", " "),
        (r"&amp;", "&"),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&#x2F;", "/"),
        (r"&#39;", "'"),
        (r"&quot;", '"'),
        (r"&apos;", "'"),
        (r"&#\d+;", " "),
        (r"&[a-zA-Z]+;", " "),
    ]),
    ("non-ascii", [
        (r"[\u00a0\u200b-\u200f\u2028\u2029\ufeff\u00ad]", " "),
        (r"[\u00a9\u00ae\u2122]", ""),
    ]),
    (None, [(SPACES, " ")]),
]
XML_TAG = r"<[^>]+>"
XML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&#x2F;", "/")]
CVE = B0 + r"CVE-\d{4}-\d{4,7}" + B1
IPV4 = (B0 + r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)" + B1)
URL = r"""https?://[^\s"'<>()\[\]{},;]+"""
SHA256 = r"(?i)(?:sha-?256|hash)[\s:=]+([0-9a-fA-F]{64})" + B1
MD5 = r"(?i)(?:md5|hash)[\s:=]+([0-9a-fA-F]{32})" + B1
FENCE = "```"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
YEAR = B0 + r"20\d{2}" + B1


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def apply_rules(c: Column, rules) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def _sql_rules(x: str, rules) -> str:
    return reduce(lambda acc, r: f"regexp_replace({acc}, {sql_str(r[0])}, {sql_str(r[1])})", rules, x)


def _sql_guard(x: str, guard: str) -> str:
    if guard == "non-ascii":
        return f"octet_length({x}) <> length({x})"
    if guard.startswith("regex:"):
        return f"{x} RLIKE {sql_str(guard[len('regex:'):])}"
    if guard.startswith("lower:"):
        return f"transform(array(lower({x})), l -> {sql_any('l', guard[len('lower:'):].split('|'))})[0]"
    return f"contains({x}, {sql_str(guard)})"


def sql_guarded(text: str, groups) -> str:
    """Apply the rule groups in order, each only where its guard holds.

    Every group is a one-element lambda: dozens of inlined regex calls make a generated
    method too large for the JIT (and, for several columns, for the JVM); a lambda body is
    not inlined, and the regex engine dominates its cost anyway.
    """
    for guard, rules in groups:
        body = _sql_rules("x", rules)
        text = (f"transform(array({text}), x -> CASE WHEN {_sql_guard('x', guard)} THEN {body} ELSE x END)[0]"
                if guard is not None else _sql_rules(text, rules))
    return text


def sql_trim(x: str) -> str:
    return f"btrim({x}, {sql_str(WS_CHARS)})"


def clean_plaintext(text: str) -> Column:
    """The long cleaner: markup, entities, LaTeX, Markdown, feed boilerplate, spacing.

    ``text`` is a column name or SQL expression; nulls clean to an empty string.
    """
    return F.expr(sql_trim(sql_guarded(f"coalesce({text}, '')", PLAINTEXT_RULES)))


def clean_text(text: str) -> Column:
    """The short cleaner for titles and names."""
    return F.expr(sql_trim(sql_guarded(f"coalesce({text}, '')", TITLE_RULES)))


def _xml_plain(x: Column) -> Column:
    return reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), XML_ENTITIES, F.regexp_replace(x, XML_TAG, " "))


def xml_text(c: Column) -> Column:
    marked = lambda x: F.when(x.contains("<") | x.contains("&"), _xml_plain(x)).otherwise(x)
    plain = F.get(F.transform(F.array(F.coalesce(c, F.lit(""))), marked), F.lit(0))
    return js_trim(F.regexp_replace(plain, SPACES, " "))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def _segments(c: Column) -> Column:
    """What lies between the fences: every second piece is a block if another fence follows."""
    return F.split(F.coalesce(c, F.lit("")), FENCE, -1)


def _language(segment: Column) -> Column:
    """The word in the line of the opening fence; null if that line holds anything else, or is not ended."""
    line = F.substring_index(segment, "\n", 1)
    return F.when(F.contains(segment, F.lit("\n")) & line.rlike(r"^\w*\z"), line)


def _body(segment: Column) -> Column:
    language = _language(segment)
    return js_trim(F.when(language.isNull(), segment).otherwise(F.substring(segment, F.length(language) + 2, F.length(segment))))


def code_blocks(c: Column) -> Column:
    """Fenced blocks as array<struct<language, content>>; empty bodies are skipped."""
    pieces = _segments(c)
    closed = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s, i: i % 2 == 1)
    blocks = F.transform(closed, lambda s: F.struct(
        F.coalesce(F.nullif(_language(s), F.lit("")), F.lit("text")).alias("language"), _body(s).alias("content")))
    return F.filter(blocks, lambda b: b["content"] != "")


def unfenced(c: Column) -> Column:
    """Text with fence and inline-code markers removed and their content kept."""
    pieces = _segments(c)
    open_end = F.size(pieces) % 2 == 0                                     # the last fence opens a block that nothing closes
    head = F.when(open_end, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    plain = F.array_join(F.transform(head, lambda s, i: F.when(i % 2 == 1, _body(s)).otherwise(s)), "")
    whole = F.concat(plain, F.when(open_end, F.concat(F.lit(FENCE), F.element_at(pieces, -1))).otherwise(F.lit("")))
    return F.regexp_replace(whole, r"`([^`\n]+)`", "$1")


def iocs(c: Column) -> Column:
    """Indicators: CVE ids, IPv4 addresses, URLs and labelled hashes, each distinct."""
    urls = F.transform(_all(c, URL), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))
    return F.struct(
        F.array_distinct(F.transform(_all(c, "(?i)" + CVE), F.upper)).alias("cves"),
        F.array_distinct(_all(c, IPV4)).alias("ips"),
        F.array_distinct(urls).alias("urls"),
        F.struct(
            F.array_distinct(F.transform(_all(c, SHA256, 1), F.lower)).alias("sha256"),
            F.array_distinct(F.transform(_all(c, MD5, 1), F.lower)).alias("md5"),
        ).alias("hashes"),
    )


def has_cve(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.contains(F.lower(c), F.lit("cve-")) & c.rlike(r"(?i)CVE-\d{4}-\d+")


def percentages(c: Column) -> Column:
    return _all(c, PERCENT, 1)


def years(c: Column) -> Column:
    return F.transform(_all(c, YEAR), lambda y: y.cast("int"))


def word_count(c: Column) -> Column:
    """Words of the trimmed text; null or empty text has none.  Blank text counts one,
    as splitting an empty string leaves one empty piece."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", 0).otherwise(F.size(F.split(js_trim(c), WS + "+")))


def normalize_title(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))),
                            r"[^\w\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", "")
    return js_trim(F.regexp_replace(kept, SPACES, " "))


def title_tokens(c: Column, stopwords, min_length: int) -> Column:
    """Distinct lower-case alphanumeric tokens, at least ``min_length`` long, no stop words."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    stop = lit_array(sorted(w for w in set(stopwords) if len(w) >= min_length))
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= min_length) & ~F.array_contains(stop, w)))


def detect_language(title: Column, summary: Column, text: Column, share: float = 0.3, max_chars: int | None = None) -> Column:
    """``non_english`` when more than ``share`` of title, summary and text is outside ASCII.  The whole text
    counts, or its first ``max_chars`` characters."""
    body = text if max_chars is None else F.substring(text, 1, max_chars)
    parts = [F.when(p != "", p) for p in (title, summary, body)]
    sample = F.concat_ws(" ", *parts)
    ascii_len = F.length(F.regexp_replace(sample, r"[^\x00-\x7F]", ""))
    n = F.length(sample)
    return (F.when(n == 0, F.lit("unknown"))
            .when((n - ascii_len) / n > share, F.lit("non_english")).otherwise(F.lit("en")))


def label_format(c: Column) -> Column:
    """Underscores to spaces and every word's first letter upper-cased, the rest kept."""
    text = F.replace(F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(c),
                     F.lit("_"), F.lit(" "))
    words = F.transform(
        F.split(text, " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)

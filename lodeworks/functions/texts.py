"""Texts: descriptions, links, commit messages, HTML escapes and error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A description is looked for in so many characters.
DESCRIBED = 5000
#: Link targets: where issues and reviews live is the user's to say.
ISSUE_URL = "https://issues.example.org/show?id="
PULL_URL = "https://code.example.org/pull/"


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _null_if_empty(c: Column, found: Column) -> Column:
    return F.when(found, c)


def html_title(html: Column) -> Column:
    head = F.substring(html, 1, DESCRIBED)
    pattern = r"(?is)<title>(.*?)</title>"
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1))


def first_line(text: Column) -> Column:
    """The first line that is not blank."""
    lines = F.filter(F.split(F.substring(text, 1, DESCRIBED), "\n"), lambda s: F.trim(s) != "")
    return F.get(lines, F.lit(0))


def docstring(text: Column) -> Column:
    head = F.substring(text, 1, DESCRIBED)
    one, two = r"(?s)'''\s*(.*?)'''", r'(?s)"""\s*(.*?)"""'
    return F.when(head.rlike(one), F.regexp_extract(head, one, 1)).when(head.rlike(two), F.regexp_extract(head, two, 1))


def module_comment(text: Column) -> Column:
    """The first run of ``//!`` lines that another line ends."""
    head = F.substring(text, 1, DESCRIBED)
    pattern = r"(?m)((?:^//!.*\n)+)"
    return F.when(head.rlike(pattern), F.rtrim(F.regexp_replace(F.regexp_extract(head, pattern, 1), r"(?m)^(?://!)+", ""), F.lit("\n")))


def block_comment(text: Column) -> Column:
    """The first ``/* */`` comment that is neither an editor line nor a licence, without leading stars."""
    bodies = F.regexp_extract_all(F.substring(text, 1, DESCRIBED), F.lit(r"(?s)/\*[*\s]*(.*?)\*/"), F.lit(1))
    plain = F.filter(bodies, lambda b: ~b.rlike("tab-width|vim:|license|LICENSE|License"))
    return F.regexp_replace(F.get(plain, F.lit(0)), r"(?m)^\s*\*", "")


def describe(path: Column, text: Column) -> Column:
    """What a file says about itself, by its kind."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    readme = F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)) == "readme"
    by_kind = F.when(ext.isin("html", "htm", "xhtml", "xml", "xul", "svg"), html_title(text)).when(ext == "rs", F.coalesce(module_comment(text), block_comment(text)))
    by_kind = by_kind.when(ext == "py", docstring(text)).when(ext.isin("css", "c", "cc", "cpp", "h", "hpp", "js", "mjs", "java", "kt", "idl"), block_comment(text))
    return by_kind.when(readme, first_line(text))


def link_issues(text: Column, url: str = ISSUE_URL) -> Column:
    """``Bug 12345`` (any case, five digits or more, a space or not) as a link."""
    return F.regexp_replace(text, r"(?i)\b(bug\s?([0-9]{5,}))\b", rf'<a href="{url}$2">$1</a>')


def link_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(https?://[^\s<>\"']+)", '<a href="$1">$1</a>')


def link_pulls(text: Column, url: str = PULL_URL) -> Column:
    """``#12`` as a link to that pull request."""
    return F.regexp_replace(text, r"#([0-9]+)", rf'#<a href="{url}$1">$1</a>')


def commit_parts(message: Column, review: str = "Differential Revision: ", pull: str = "Pull request: ") -> Column:
    """struct<header, remainder, review, pull> of a commit message; the first line that starts so counts."""
    lines = F.split(message, "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))

    def after(prefix: str) -> Column:
        found = F.get(F.filter(rest, lambda s: s.startswith(prefix)), F.lit(0))
        return F.substring(found, F.lit(len(prefix) + 1), F.char_length(found))

    return F.struct(F.get(lines, F.lit(0)).alias("header"), F.array_join(rest, "\n").alias("remainder"), after(review).alias("review"), after(pull).alias("pull"))


def error_code(code: Column) -> Column:
    """struct<failed, module, code> of a 32-bit result: severity bit, module number (offset 0x45), low 16 bits."""
    return F.struct((F.shiftrightunsigned(code, 31).bitwiseAND(F.lit(1)) == 1).alias("failed"), (F.shiftright(code, 16).bitwiseAND(F.lit(0x1FFF)) - 0x45).alias("module"), code.bitwiseAND(F.lit(0xFFFF)).alias("code"))


def scip_kind(roles: Column) -> Column:
    """Bit 1 of a symbol's roles is a definition; all others are uses."""
    return F.when(roles.bitwiseAND(F.lit(1)) == 1, "def").otherwise("use")

"""Column functions over the XML of wiki pages, for eight languages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_OPEN, TEXT_CLOSE = '<text xml:space="preserve">', "</text>"


@dataclass(frozen=True)
class Language:
    """Marks of one language: what starts a redirect, the pattern of a disambiguation page, and literal marks of one."""

    code: str
    redirects: tuple[str, ...] = ("#REDIRECT", "#redirect")
    disambiguation: str | None = None
    literals: tuple[str, ...] = field(default=())


#: Marks of each language (fixed values).
LANGUAGES = {
    "en": Language("en", disambiguation=r"\{\{disambig\w*\}\}"),
    "sv": Language("sv", ("#REDIRECT", "#redirect", "#OMDIRIGERING", "#omdirigering", "#Omdirigering"), None, ("{{förgrening}}", "{{Förgrening}}")),
    "de": Language("de", ("#REDIRECT", "#redirect", "#WEITERLEITUNG", "#weiterleitung", "#Weiterleitung"), r"\{\{begriffsklärung\}\}"),
    "cs": Language("cs", disambiguation=r"\{\{rozcestník\}\}"),
    "es": Language("es", disambiguation=r"\{\{desambiguación\}\}"),
    "ar": Language("ar", disambiguation=r"\{\{توضيح\}\}"),
    "tr": Language("tr", disambiguation=r"\{\{anlam ayrımı\}\}"),
    "zh": Language("zh", disambiguation=r"\{\{disambig.+Cat=.+\}\}"),
}


def language(code: str | None) -> Language:
    """The language of a code in either case; English for any other."""
    return LANGUAGES.get((code or "en").lower(), LANGUAGES["en"])


def _first(page: Column, tag: str) -> Column:
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(page.rlike(pattern), F.regexp_extract(page, pattern, 1))


def title(page: Column) -> Column:
    return unescape(_first(page, "title"))


def page_id(page: Column) -> Column:
    return _first(page, "id")


def markup(page: Column) -> Column:
    """The text between the text tags; null without them."""
    start = F.instr(page, TEXT_OPEN)
    rest = F.substr(page, (start + len(TEXT_OPEN)).cast("int"))
    return F.when((start > 0) & (F.instr(rest, TEXT_CLOSE) > 0), F.substring_index(rest, TEXT_CLOSE, 1))


def after_text_start(page: Column) -> Column:
    start = F.instr(page, TEXT_OPEN)
    return F.when(start > 0, F.substr(page, start.cast("int")))


def is_article(page: Column) -> Column:
    """Namespace 0; a page without a namespace is an article."""
    return F.coalesce(F.trim(_first(page, "ns")), F.lit("0")) == "0"


def is_redirect(page: Column, lang: str = "en") -> Column:
    text, found = markup(page), F.lit(False)
    for mark in language(lang).redirects:
        found = found | text.startswith(mark)
    return F.coalesce(found, F.lit(False))


def is_stub(page: Column) -> Column:
    return F.coalesce(after_text_start(page).contains("stub}}"), F.lit(False)) | page.contains("Wikipedia:Stub")


def is_disambiguation(page: Column, lang: str = "en") -> Column:
    marks = language(lang)
    if marks.disambiguation:
        return page.rlike(f"(?iu){marks.disambiguation}")
    found = F.lit(False)
    for literal in marks.literals:
        found = found | F.coalesce(after_text_start(page).contains(literal), F.lit(False))
    return found


def is_empty(page: Column) -> Column:
    return markup(page).isNull()


def links(page: Column) -> Column:
    """Array of (anchor, target): what stands in [[ ]], but nothing with a colon; target before | and #, anchor after |."""
    inner = F.filter(F.regexp_extract_all(page, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1)), lambda x: (x != "") & ~x.contains(":"))

    def link(x: Column) -> Column:
        target = F.substring_index(F.substring_index(x, "|", 1), "#", 1)
        return F.struct(F.when(x.contains("|"), F.substr(x, (F.instr(x, "|") + 1).cast("int"))).otherwise(target).alias("anchor"), target.alias("target"))

    return F.filter(F.transform(inner, link), lambda x: x["target"] != "")


def link_targets(page: Column) -> Column:
    return F.transform(links(page), lambda x: x["target"])


def interlanguage_link(page: Column, code: str) -> Column:
    """The first [[code:...]]; null if there is none, or it is empty or goes over a line end."""
    pattern = rf"(?s)\[\[{code}:(.*?)\]\]"
    found = F.regexp_extract(page, pattern, 1)
    return F.when((found != "") & ~found.contains("\n"), found)


def normalized_target(target: Column) -> Column:
    return F.replace(F.lower(target), F.lit(" "), F.lit("_"))


def unescape(text: Column) -> Column:
    """HTML entities of markup, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def content(page: Column) -> Column:
    """Plain text of a page: links as their anchors, without marks, references, comments, addresses, templates and tags."""
    text = F.regexp_replace(markup(page), r"\[\[[a-z\-]+:[^\]]+\]\]", "")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"'{2,}", ""), r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    text = unescape(unescape(text))
    for pattern in (r"(?s)<ref>.*?</ref>", r"(?s)<!--.*?-->", r"http://[^\s\]]+", r"(?s)\{\{.*?\}\}", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " " if pattern.startswith("<[") else "")
    return text


def display_content(page: Column) -> Column:
    """The page as HTML, with its title as heading; its type is text/html."""
    return F.concat(F.lit("<h1>"), F.coalesce(title(page), F.lit("")), F.lit("</h1>\n"), F.coalesce(content(page), F.lit("")))

"""Text functions as column expressions, and HTML to text as an Arrow UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the token pattern.
TOKEN = r"[a-z0-9]+(?:[._][a-z0-9]+)*"


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def parse_tags(raw: Column) -> Column:
    """<a><b> or |a|b| to an array; null or empty to an empty array."""
    bars = F.filter(F.split(raw, r"\|"), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(raw, F.lit("")) == "", empty).when(raw.startswith("|"), bars).otherwise(F.regexp_extract_all(raw, F.lit("<([^<>]+)>"), F.lit(1)))


def query_text(title: Column, body: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.coalesce(body, F.lit("")) == "", t).otherwise(F.concat(t, F.lit("\n\n"), body))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


class _Text(HTMLParser):
    """Collects text; code is fenced or quoted, block tags become line breaks, images and scripts vanish."""

    # Tags with line breaks on both sides, and behind only.
    AROUND = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "hr"})
    AFTER = frozenset({"br", "li", "tr"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.pre: list[str] | None = None
        self.pre_code: list[str] | None = None
        self.in_code = False

    def put(self, s: str) -> None:
        if self.pre is not None:
            self.pre.append(s)
            if self.in_code and self.pre_code is not None:
                self.pre_code.append(s)
        else:
            self.out.append(s)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "pre" and self.pre is None:
            self.pre, self.pre_code = [], None
        elif tag == "code":
            if self.pre is None:
                self.out.append("`")
            elif self.pre_code is None:
                self.pre_code, self.in_code = [], True
        elif tag in self.AROUND and self.pre is None:
            self.out.append("\n")
            if tag == "hr":
                self.out.append("\n")
        elif tag == "br":
            self.put("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in ("script", "style"):
            self.handle_starttag(tag, attrs)
            if tag in ("code", "pre"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre" and self.pre is not None:
            body = "".join(self.pre if self.pre_code is None else self.pre_code).strip()
            self.pre, self.in_code = None, False
            self.out.append(f"\n```\n{body}\n```\n")
        elif tag == "code":
            if self.pre is None:
                self.out.append("`")
            self.in_code = False
        elif self.pre is None and (tag in self.AROUND - {"hr"} or tag in self.AFTER - {"br"}):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.put(data)


def clean_html(html: str | None) -> str:
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    if p.pre is not None:
        p.handle_endtag("pre")
    s = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", s)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(clean_html)

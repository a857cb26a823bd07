"""The body of a page: one container's visible text, its images in place, and what the page says of itself."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import _Visible, squeeze_lines

#: Elements without an end, where an image's address and size may stand, and what names title and author.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_IMAGE_KEYS = {"reference": ("data-src", "data-original", "src"), "width": ("data-w", "width"), "height_ratio": ("data-ratio",), "alt": ("alt",)}
_TITLE_KEYS = ("og:title", "twitter:title")
_AUTHOR_KEYS = ("author", "og:article:author")
PROFILES = ("auto", "generic", "article")

IMAGE = "struct<position int, chars_before int, reference string, width string, height_ratio string, alt string>"
BODY = f"body string, containers int, status string, title string, authors array<string>, author_status string, images array<{IMAGE}>"


class _Page(_Visible):
    """Visible text of the elements that open inside a container, by the stack of what is open."""

    def __init__(self, element_id: str | None, tag: str | None) -> None:
        super().__init__()
        self.wanted = (element_id, tag)
        self.open: list[str] = []
        self.containers = self.chars = 0
        self.images: list[dict[str, Any]] = []
        self.named: dict[str, list[str]] = {}
        self.heading: list[str] = []
        self.in_title = False

    def _opens(self, tag: str, found: dict[str, str | None]) -> bool:
        element_id, name = self.wanted
        return (element_id is None or found.get("id") == element_id) and (name is None or tag == name)

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        key, content = (found.get("name") or found.get("property") or "").strip().lower(), (found.get("content") or "").strip()
        if tag == "meta" and key and content:
            self.named.setdefault(key, []).append(content)
        self.in_title = self.in_title or tag == "title"
        if not self.open:
            if self._opens(tag, found):
                self.open.append(tag)
                self.containers += 1
            return
        if tag not in _VOID:
            self.open.append(tag)
        super().handle_starttag(tag, attrs)
        if tag == "img" and not self.skip:
            image = {name: next((found[k] for k in keys if found.get(k)), None) for name, keys in _IMAGE_KEYS.items()}
            self.images.append({"position": len(self.images) + 1, "chars_before": self.chars} | image)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if not self.open:
            return
        super().handle_endtag(tag)
        if tag in self.open:  # whatever was left open inside ends with it
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.in_title:
            self.heading.append(data)
        if self.open:
            super().handle_data(data)
            if not self.skip:
                self.chars += len("".join(data.split()))


def page_body(html: str, element_id: str | None = None, tag: str | None = None, profile: str = "auto") -> tuple:
    """(body, containers, status, title, authors, author_status, images) of one page.

    Profile auto takes the whole page's visible text where there is no container,
    article leaves the body empty then, generic always takes the whole page.
    """
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    if element_id is None and tag is None:
        raise ValueError("a container needs an id or a tag")
    page = _Page(element_id, tag)
    page.feed(html)
    page.close()
    text = squeeze_lines("".join(page.out)) if profile != "generic" else ""
    status = "confirmed" if page.containers == 1 else "several" if page.containers else "missing"
    if profile == "generic" or profile == "auto" and not page.containers:
        whole = _Visible()
        whole.feed(html)
        whole.close()
        text, status = squeeze_lines("".join(whole.out)), "whole_page"
    one = lambda x: re.sub(r"\s+", " ", x).strip()
    titles = [one(x) for k in _TITLE_KEYS for x in page.named.get(k, [])] + [one("".join(page.heading))]
    authors = list(dict.fromkeys(filter(None, (one(x) for k in _AUTHOR_KEYS for x in page.named.get(k, [])))))
    author_status = ("missing", "single_confirmed")[len(authors)] if len(authors) < 2 else "conflicting"
    return text, page.containers, status, next(filter(None, titles), ""), authors, author_status, page.images


def page_bodies(pages: DataFrame, key: str, html: str = "html", element_id: str | None = None, tag: str | None = None, profile: str = "auto") -> DataFrame:
    """key and BODY of every page; a null page has null fields. Pages go to Python in Arrow batches and nothing is shuffled."""

    @F.pandas_udf(T.StructType.fromDDL(BODY))
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 7 if t is None else page_body(t, element_id, tag, profile) for t in texts]
        out = pd.DataFrame(rows, columns=["body", "containers", "status", "title", "authors", "author_status", "images"], dtype="object")
        return out.astype({"containers": "Int32"})

    return pages.select(key, parse(F.col(html)).alias("_body")).select(key, "_body.*")

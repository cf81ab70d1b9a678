"""Entries of RSS and Atom feeds: a pull parser, and a tolerant one for what isn't XML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree.ElementTree import ParseError, XMLPullParser

# Names of the formats.
ITEMS = ("item", "entry")
MEDIA = "http://search.yahoo.com/mrss/"
CHUNK = 1 << 16

#: What happens within an item: ("start", tag, attributes) or ("text", tag, text).
Event = tuple[str, str, object]


def _name(tag: str) -> str:
    """A local name in lower case; media names keep their prefix."""
    if tag[:1] == "{":
        space, local = tag[1:].rsplit("}", 1)
        return ("media:" if space.rstrip("/") + "/" == MEDIA else "") + local.lower()
    return tag.lower()


def _strict(data: bytes) -> Iterator[list[Event]]:
    """Items as they end; a ParseError where the data isn't XML. Finished items are dropped, so memory is one item's."""
    parser, depth, held, path = XMLPullParser(("start", "end")), 0, [], []
    for at in range(0, len(data), CHUNK):
        parser.feed(data[at : at + CHUNK])
        for kind, element in parser.read_events():
            name = _name(element.tag)
            if kind == "start":
                path.append(element)
                if depth or name in ITEMS:
                    depth += 1
                    if depth > 1:
                        held.append(("start", name, {_name(k): v for k, v in element.attrib.items()}))
                continue
            path.pop()
            if not depth:
                continue
            depth -= 1
            if depth:
                held.append(("text", name, "".join(element.itertext())))
            else:
                yield held
                held = []
                element.clear()
                if path:
                    path[-1].remove(element)
    parser.close()


class _Loose(HTMLParser):
    """Items of anything with tags; an item also ends where the next one starts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list[Event]] = []
        self.held: list[Event] | None = None
        self.open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ITEMS:
            self._end()
            self.held, self.open = [], []
        elif self.held is not None:
            self.held.append(("start", tag, {k: v or "" for k, v in attrs}))
            self.open.append((tag, []))

    def handle_startendtag(self, tag, attrs):
        if self.held is not None and tag not in ITEMS:
            self.held.append(("start", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if tag in ITEMS:
            self._end()
        elif self.held is not None and any(t == tag for t, _ in self.open):
            while True:
                name, texts = self.open.pop()
                self.held.append(("text", name, "".join(texts)))
                if name == tag:
                    return
                if self.open:
                    self.open[-1][1].extend(texts)

    def handle_data(self, data):
        if self.open:
            self.open[-1][1].append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def _end(self):
        if self.held is not None:
            self.items.append(self.held)
        self.held = None


def _decoded(data: bytes) -> str:
    declared = re.match(rb"""\s*<\?xml[^>]*encoding=["']([\w.-]+)""", data)
    try:
        return data.decode(declared[1].decode() if declared else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def moment(text: str | None) -> datetime | None:
    """A date of either format, in UTC; without a zone it is UTC; null where it is neither."""
    text = (text or "").strip()
    for parse in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            found = parse(text)
            return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC)
        except (ValueError, TypeError, IndexError, OverflowError):
            continue
    return None


def _entry(events: list[Event]) -> dict | None:
    texts: dict[str, str] = {}
    for kind, tag, value in events:
        if kind == "text" and value.strip():
            texts.setdefault(tag, value.strip())
    links = [a for kind, tag, a in events if kind == "start" and tag == "link" and a.get("href", "").strip()]
    link = texts.get("link") or next((a["href"] for a in links if a.get("rel", "alternate") == "alternate"), links[0]["href"] if links else "")
    if not link.strip():
        return None
    starts = lambda name: [a for kind, tag, a in events if kind == "start" and tag == name]
    image = [a.get("url") for a in starts("media:content") if "image" in a.get("type", "") or a.get("medium") == "image"]
    image += [a.get("url") for a in starts("media:thumbnail")]
    image += [a.get("url") or a.get("href") for a in [*starts("enclosure"), *(a for a in links if a.get("rel") == "enclosure")] if "image" in a.get("type", "")]
    dates = (moment(texts.get(t)) for t in ("pubdate", "published", "updated", "date", "dc:date"))
    return {"url": link.strip(), "title": texts.get("title", ""), "published_at": next((d for d in dates if d), None), "image_url": next((u for u in image if u), None)}


def entries(data: bytes) -> tuple[list[dict], bool]:
    """(entries, whether the feed is well formed). Entries without a link go. Of a malformed feed what a tolerant reader finds counts, if the strict one
    finds no more before the error."""
    found: list[dict] = []
    try:
        for item in _strict(data):
            if entry := _entry(item):
                found.append(entry)
        return found, True
    except (ParseError, ValueError):
        loose = _Loose()
        loose.feed(_decoded(data))
        loose.close()
        loose._end()
        more = [e for e in map(_entry, loose.items) if e]
        return (more if len(more) >= len(found) else found), False

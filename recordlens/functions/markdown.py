"""Web pages as Markdown: one pass over the tags of a page with a stack of what is open.

Only tags that change what they hold are put on the stack (links, emphasis, code, headings, list items, tables, rows, cells);
others only break blocks, so deeply nested pages cost no more than flat ones.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags whose content is no text of the page.
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote", "ul", "ol", "dl", "dt", "dd", "figure", "form", "hr", "title"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
#: A new one of these ends an open one of those, up to the tag behind them.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
FRAMED = {*MARKS, *HEADINGS, "a", "pre", "li", "ul", "ol", "table", "tr", "td", "th", "title"}
ASSETS = {"img": "src", "script": "src", "link": "href", "source": "src", "iframe": "src", "video": "src", "audio": "src"}


def _line(text: str) -> str:
    return " ".join(text.split())


class _Page(HTMLParser):
    def __init__(self, keep_links: bool):
        super().__init__(convert_charrefs=True)
        self.keep_links, self.stack, self.hidden = keep_links, [("", {}, [])], []
        self.page_title, self.links, self.assets = None, [], []
        # Where the content of the first title begins and ends in the page.
        self.title_at = [None, None]

    def put(self, text: str) -> None:
        self.stack[-1][2].append(text)

    def open(self, tag: str) -> bool:
        return any(t == tag for t, _, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        given = dict(reversed(attrs))
        if given.get(ASSETS.get(tag, "")):
            self.assets.append(given[ASSETS[tag]])
        if tag in HIDDEN or self.hidden:
            if tag in HIDDEN:
                self.hidden.append(tag)
            if tag == "title":
                self.stack.append((tag, given, []))
                self.mark_title(0)
            return
        if tag in ENDS:
            inner, outer = ENDS[tag]
            while self.stack[-1][0] in inner or (self.stack[-1][0] in {*MARKS, "a"} and any(t in inner for t, _, _ in self.stack) and not self.stack[-1][0] in outer):
                self.close_last()
        if tag in FRAMED:
            self.stack.append((tag, given, []))
            if tag == "title":
                self.mark_title(0)
        elif tag == "br":
            self.put("\n")
        elif tag == "img":
            self.put(f"![{_line(given.get('alt') or '') or 'image'}]")
        elif tag in BLOCKS:
            self.put("\n\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in FRAMED or tag in HIDDEN:
            self.handle_endtag(tag)

    def mark_title(self, end: int) -> None:
        """Note a title's tag, if it is the first one that opens, or that closes behind it, and is not in a script or the like."""
        if self.title_at[end] is None and set(self.hidden) <= {"head"} and (not end or self.title_at[0]):
            self.title_at[end] = (*self.getpos(), 0 if end else len(self.get_starttag_text()))

    def title_source(self, html: str) -> str | None:
        """The first title as it is written, references included; null if there is none or it does not end."""
        if None in self.title_at:
            return None
        lines = html.split("\n", self.title_at[1][0])
        start, end = (sum(len(x) + 1 for x in lines[: line - 1]) + column + tag for line, column, tag in self.title_at)
        return re.sub("[ \t\n\f\r]+", " ", html[start:end]).strip(" ")

    def handle_endtag(self, tag):
        if tag == "title":
            self.mark_title(1)
        if self.hidden:
            if tag == "title" and self.stack[-1][0] == "title":
                self.page_title = self.page_title or _line("".join(self.stack.pop()[2])) or None
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in FRAMED and self.open(tag):
            while self.close_last() != tag:
                pass
        elif tag in BLOCKS:
            self.put("\n\n")

    def handle_data(self, data):
        if not self.hidden or self.stack[-1][0] == "title":
            self.put(data if self.open("pre") else data.replace("\r", " ").replace("\n", " "))

    def close_last(self) -> str:
        tag, given, parts = self.stack.pop()
        text = "".join(parts)
        flat = _line(text)
        if tag in MARKS:
            inside = text.strip()
            out = text if not inside or self.open("pre") else f"{text[: len(text) - len(text.lstrip())]}{MARKS[tag]}{inside}{MARKS[tag]}{text[len(text.rstrip()) :]}"
        elif tag in HEADINGS:
            out = f"\n\n{HEADINGS[tag]} {flat}\n\n" if flat else "\n\n"
        elif tag == "a":
            href = given.get("href")
            if href:
                self.links.append((href, flat))
            out = f"[{flat or href}]({href})" if href and self.keep_links else text
        elif tag == "pre":
            out = "\n\n```\n" + text.strip("\n").replace("\n", "\x00").replace(" ", "\x01") + "\n```\n\n" if flat else "\n\n"
        elif tag == "li":
            # The first line is the item; lines of lists inside it are indented, and their depth grows from level to level.
            lines = [x for x in (x.rstrip() for x in text.split("\n")) if x.strip()]
            out = "\n- " + "\n".join(x.strip(" ") if k == 0 else f"\x01\x01{x.strip(' ')}" for k, x in enumerate(lines)) if lines else "\n"
        elif tag in ("ul", "ol"):
            out = f"\n{text}\n" if self.open("li") else f"\n\n{text}\n\n"
        elif tag in ("td", "th"):
            out = f"\x02{flat}"
        elif tag == "tr":
            cells = [c.strip() for c in text.split("\x02")[1:]]
            out = f"\x03| {' | '.join(cells)} |" if cells else ""
        elif tag == "table":
            rows = [_line(r) for r in text.split("\x03")[1:]]
            out = text if not rows else " " + " ".join(rows) + " " if self.open("td") or self.open("th") else "\n\n" + "\n".join(rows) + "\n\n"
        else:
            out = f"\n\n{text}\n\n"
            self.page_title = self.page_title or flat or None
        self.put(out)
        return tag

    def text(self) -> str:
        while len(self.stack) > 1:
            self.close_last()
        out, blank = [], True
        for line in "".join(self.stack[0][2]).replace("\x02", " ").replace("\x03", " ").split("\n"):
            line = _line(line.replace("\xa0", " ").replace("\u202f", " "))
            if line or not blank:
                out.append(line)
            blank = not line
        return "\n".join(out).strip().replace("\x00", "\n").replace("\x01", " ")


def convert(html: str | None, keep_links: bool = True) -> tuple[str, str | None, list, list, str | None]:
    """Markdown, title, links (href, anchor), assets and the title's source of a page; null and empty pages have none."""
    page = _Page(keep_links)
    # Characters that stand for something here are no text.
    html = (html or "").translate({0: " ", 1: " ", 2: " ", 3: " "})
    page.feed(html)
    page.close()
    markdown = page.text()
    return markdown, page.page_title, page.links, page.assets, page.title_source(html)


def pages_markdown(pages: DataFrame, keep_links: bool = True) -> DataFrame:
    """page_id, title, markdown, links, assets, title_source (the title with its references as written) of pages (page_id, html)."""

    def run(batches):
        links = pa.list_(pa.struct([("href", pa.string()), ("anchor", pa.string())]))
        for b in batches:
            got = [convert(h.as_py(), keep_links) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([g[1] for g in got], pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([[dict(zip(("href", "anchor"), x, strict=True)) for x in g[2]] for g in got], links), pa.array([g[3] for g in got], pa.list_(pa.string())), pa.array([g[4] for g in got], pa.string())],
                ["page_id", "title", "markdown", "links", "assets", "title_source"],
            )

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, title string, markdown string, links array<struct<href:string,anchor:string>>, assets array<string>, title_source string")

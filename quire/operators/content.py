"""Blocks and sections from lines: headings, zones of verse, paragraphs, entries, embedded regions.

A document's lines are one course of events (a paragraph runs on over a page's end, a heading closes the sections under
it), so each document is folded by itself; documents are parted by Spark. Lines are dicts as quire.operators.lines makes
them, furniture left out.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from math import floor

import re as plain

import regex as re

from quire.operators.lexicon import SHORT_WORDS
from quire.operators.systems import PROSE, Tree

# How divisions are headed and what they are, and in which order they hold one another.
DIVISION = re.compile(r"(book|volume|part|chapter|canto|act|scene|section|appendix|letter)\s+([0-9]+|[IVXLCDM]+|[A-Za-z]+(?:-[A-Za-z]+)?)(?![A-Za-z0-9_])[.:—–-]?\s*(.*)", re.IGNORECASE)
BACK = re.compile(r"(explanatory\s+)?(notes?|endnotes|commentary|bibliography|works\s+cited|further\s+reading|suggestions\s+for\s+further\s+reading|glossary|index|abbreviations|textual\s+notes?|list\s+of\s+illustrations|illustrations)(?![A-Za-z0-9_])", re.IGNORECASE)
FRONT = re.compile(r"(contents|introduction|preface|foreword|translator|acknowledg|a note on|dedication|title page|copyright|about the|chronology|maps?)(?![A-Za-z0-9_])", re.IGNORECASE)
DIVISIONS = {"volume": "volume", "book": "book", "part": "part", "chapter": "chapter", "canto": "chapter", "act": "chapter", "scene": "section", "letter": "chapter", "section": "section", "appendix": "appendix"}
RANK = {"root": -1, "frontmatter": 0, "apparatus": 0, "appendix": 0, "volume": 0, "book": 1, "part": 1, "chapter": 2, "section": 3}
NUMBERS = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), range(1, 21), strict=True)) | {"thirty": 30, "forty": 40, "fifty": 50}
LETTERS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

ENTRY = re.compile(r"[\[(]?\s*([0-9]{1,4}[a-z]?|[*†‡§¶]+|[IVXLC]+)\s*[\].):]?\s+\S")
HARD_KEY = re.compile(r"[\[(]?\s*([0-9]{1,4}[a-z]?|[*†‡§¶]+)\s*[\].):]\s+\S")
BULLET = re.compile(r"\s*([•·‣▪*]|[-–—]\s)")
ITEM = re.compile(r"\s*\(?([0-9]{1,2}|[a-z]|[ivxIVX]{1,4})[.)]\s+\S")
BIG, INDENT, ZONE = 1.12, 6.0, 24.0


# Fixed values, compiled once: what lines, words and headings are told by, in the order of their use below. Patterns that are
# sought along whole texts and ask for no property of Unicode are Python's own, which are quicker.
ROMAN = re.compile("[IVXLCDM]+", re.IGNORECASE)
SMALL_START, KEPT_HYPHEN, HYPHEN_END = re.compile("[a-z]"), re.compile("[-‐]$"), re.compile(r"[-‐]\s*$")
HALF_WORD, REST_WORD, TAIL_WORD = re.compile("([A-Za-zÀ-ɏ]+)[-‐]$"), re.compile("[a-zÀ-ɏ]+"), re.compile("[A-Za-z’']+$")
COMPOUND = plain.compile("([A-Za-zÀ-ɏ]{2,})[-‐]([A-Za-zÀ-ɏ]{2,})")
HUNG, NUMBERED_TEXT = re.compile("[0-9]{1,4}"), re.compile(r"[0-9]{1,4}\s+\S")
CAPITAL_START, CLOSED = re.compile("[“\"'(]?[A-ZΑ-Ω]"), re.compile("[.!?:;”’\"]\\s*$")
NO_OPENING, NO_END, NUMERAL_HEAD = re.compile("[a-z‘“\"(]|[-–—,;:]"), re.compile("[,;:]$|[a-z-]$"), re.compile(r"[IVXLC]+\.?", re.IGNORECASE)
SMALL_LETTER, LARGE_LETTER = re.compile("[a-z]"), re.compile("[A-Z]")
KEYED_RUN = re.compile(r"\s*[0-9]{1,4}[a-z]?\s*")
NOT_SPELLED, BARE, DIGIT, BRACKET = re.compile("[^A-Za-z ]"), re.compile("[^a-z0-9]"), re.compile("[0-9]"), re.compile(r"[(\[]")
CLOSERS = frozenset(".!?”’\"")


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else 0.0


def first_mode(values: list[float], step: float) -> float:
    """The bin of a step's width that most values round to, of equals the one met first."""
    bins = Counter(floor(v / step + 0.5) * step for v in values)
    return float(bins.most_common(1)[0][0]) if bins else 0.0


def roman(token: str) -> int | None:
    if not ROMAN.fullmatch(token):
        return None
    v = [LETTERS[c] for c in token.upper()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


def number(token: str) -> int | None:
    """Digits, English number words added up, or a roman numeral."""
    if token.isascii() and token.isdigit():
        return int(token)
    words = [w for w in re.split(r"[\s-]+", token.lower()) if w]
    if words and all(w in NUMBERS for w in words):
        return sum(NUMBERS[w] for w in words)
    return roman(token)


def heading_of(text: str) -> dict:
    """type, label, number and title of a heading."""
    clean = " ".join(text.split())
    m = DIVISION.fullmatch(clean)
    n = number(m[2]) if m else None
    if n is not None:
        return {"type": DIVISIONS[m[1].lower()], "label": f"{m[1].capitalize()} {n}", "number": n, "title": m[3].strip()}
    kind = "apparatus" if BACK.match(clean) else "frontmatter" if FRONT.match(clean) else "section"
    return {"type": kind, "label": clean, "number": None, "title": clean}


def joiner(before: str, after: str, compounds: set[str]) -> str:
    """What stands between two lines: nothing within a word, a hyphen within a known compound, else a space."""
    before, after = before.rstrip(), after.lstrip()
    if not SMALL_START.match(after):
        return " "
    before = before[before.rfind(" ") + 1 :]  # no more than its last word is asked for
    if KEPT_HYPHEN.search(before):
        a, b = HALF_WORD.search(before), REST_WORD.match(after)
        return "-" if a and b and f"{a[1]}-{b[0]}".lower() in compounds else ""
    tail = TAIL_WORD.search(before)
    bare = tail[0].lower().replace("’", "").replace("'", "") if tail else ""
    return "" if tail and len(bare) <= 2 and bare not in SHORT_WORDS else " "


def compounds_of(lines: list[dict]) -> set[str]:
    return {f"{m[1]}-{m[2]}".lower() for line in lines if "-" in line["text"] or "‐" in line["text"] for m in COMPOUND.finditer(line["text"])}


FLAGS = ("em", "strong", "sup", "sub", "code", "sc")
SPACES = re.compile(r"\s+")


def squeezed(text: str) -> str:
    """White space as single spaces; no white space but the space itself is printable, so most texts are returned as they are."""
    return text if "  " not in text and text.isprintable() else SPACES.sub(" ", text)


def flags_of(run: dict) -> dict[str, bool]:
    return {f: True for f in FLAGS if f in run and run[f]}


def tidy_runs(runs: list[dict]) -> list[dict]:
    """Neighbours of one format joined, white space squeezed, empty ones gone; where each came from is kept."""
    out: list[dict] = []
    for r in runs:
        flags = flags_of(r)
        sources = list(r.get("sources") or ([{"page": r.get("page"), "o": r["o"]}] if r.get("o") is not None else []))
        if out and flags_of(out[-1]) == flags:
            out[-1]["t"] += r["t"]
            out[-1]["sources"] += sources
        elif r["t"].strip() or out:
            out.append({"t": r["t"], "sources": sources, **flags})
    for r in out:
        r["t"] = squeezed(r["t"])
    return [r for r in out if r["t"]]


def closes(text: str) -> bool:
    """Whether a sentence is over where a text ends, looked at from its end."""
    k = len(text)
    while k and SPACES.match(text, k - 1):
        k -= 1
    return text[k - 1 : k] in CLOSERS


def joined(text: str, more: str) -> str:
    """more at the end of a text whose white space is squeezed; work in proportion to what is new."""
    more = squeezed(more)
    return text + (more[1:] if more.startswith(" ") and text.endswith(" ") else more)


def run_on(runs: list[dict], more: list[dict]) -> list[dict]:
    """Runs at the end of tidy ones, joined and squeezed as tidy_runs has it."""
    runs = [r for r in runs if r["t"]]
    if not runs:
        return tidy_runs(more)
    for r in more:
        flags = flags_of(r)
        sources = list(r.get("sources") or ([{"page": r.get("page"), "o": r["o"]}] if r.get("o") is not None else []))
        if flags_of(runs[-1]) == flags:
            runs[-1]["t"] = joined(runs[-1]["t"], r["t"])
            runs[-1]["sources"] += sources
        elif r["t"]:
            runs.append({"t": squeezed(r["t"]), "sources": sources, **flags})
    return runs


@dataclass
class Profile:
    """Measures of a document's page."""

    body: float = 12.0
    indent: float = 0.0
    left: float = 0.0
    right: float = 0.0
    leading: float = 0.0

    @property
    def width(self) -> float:
        return max(80.0, self.right - self.left)

    @classmethod
    def of(cls, lines: list[dict]) -> Profile:
        long = [line for line in lines if len(line["text"]) > 40]
        rights = sorted(line["right"] for line in long)
        right = rights[min(len(rights) - 1, int(len(rights) * 0.9))] if rights else 0.0
        indent = first_mode([line["x"] for line in long], 1.0)
        full = [line["x"] for line in long if line["right"] >= right - 8]
        return cls(
            body=first_mode([line["size"] for line in long], 0.5) or 12.0, indent=indent, right=right,
            left=(first_mode(full, 1.0) if len(full) > 20 else 0.0) or indent, leading=first_mode([line["gap"] for line in lines if 2 < line["gap"] < 60], 0.5),
        )


def margins(line: dict) -> tuple[float, float]:
    """Left and right of a line without numbers hung beside it."""
    runs = [r for r in line["runs"] if r["t"].strip()]
    left, right = line["x"], line["right"]
    if len(runs) > 1:
        if HUNG.fullmatch(runs[0]["t"].strip()) and runs[1]["x"] - runs[0]["x"] > len(runs[0]["t"]) * line["size"] * 0.5 + 4:
            left = runs[1]["x"]
        if HUNG.fullmatch(runs[-1]["t"].strip()) and runs[-1]["x"] - runs[-2]["x"] > 30:
            right = runs[-2]["x"]
    return left, right


def zones(lines: list[dict], profile: Profile) -> list[tuple[bool, float]]:
    """For each line of a page: whether it is in a zone of verse, and the zone's left edge.

    A zone is a run of lines indented past the prose; it is verse by hung numbers, by lines that stop well short, or by
    capitals after half of the breaks within a sentence.
    """
    info = [[*margins(line), False] for line in lines]
    for k, line in enumerate(lines):
        info[k][2] = (info[k][0], info[k][1]) != (line["x"], line["right"])
        near = k - 1 if k else 1
        if not info[k][2] and NUMBERED_TEXT.match(line["text"]) and near < len(lines) and not NUMBERED_TEXT.match(lines[near]["text"]) and 8 < info[near][0] - info[k][0] < 70:
            info[k][0], info[k][2] = info[near][0], True
    out = [(False, profile.left)] * len(lines)
    k = 0
    while k < len(lines):
        end = k
        while end < len(lines) and info[end][0] >= profile.left + ZONE:
            end += 1
        if end > k:
            rights = [r for left, r, _ in info[k:end] if r - left > profile.width * 0.4]
            breaks = [(a["text"], b["text"]) for a, b in zip(lines[k:end], lines[k + 1 : end], strict=False)]
            capitals = sum(bool(CAPITAL_START.match(b)) and not CLOSED.search(a) for a, b in breaks)
            verse = any(n for *_, n in info[k:end]) or upper_median(rights) < profile.right - profile.width * 0.12 or (end - k > 2 and capitals / (end - k - 1) >= 0.5)
            out[k:end] = [(verse, first_mode([left for left, *_ in info[k:end]], 1.0))] * (end - k)
        k = max(end, k + 1)
    return out


@dataclass
class _Assembly:
    profile: Profile
    compounds: set[str]
    title: str
    blocks: list[dict] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    stack: list[dict] = field(default_factory=list)
    open: dict | None = None
    verse_line: int = 0
    squeezed: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.enter({"type": "root", "label": self.title, "number": None, "title": self.title}, 1, -1)

    def enter(self, info: dict, page: int, spine: int | None) -> dict:
        """Open a section; spine: its depth in the outline, or None for a heading of the text."""
        if spine is not None:
            while len(self.stack) > 1 and not (self.stack[-1]["spine"] is not None and self.stack[-1]["spine"] < spine):
                self.leave()
        else:
            while len(self.stack) > 1 and self.stack[-1]["spine"] is None and RANK[self.stack[-1]["type"]] >= RANK[info["type"]]:
                self.leave()
        node = {"section_id": f"s{len(self.sections)}", **info, "page": page, "parent": self.stack[-1]["section_id"] if self.stack else None, "depth": len(self.stack), "start": len(self.blocks), "end": len(self.blocks), "spine": spine, "verse": False}
        self.sections.append(node)
        self.stack.append(node)
        self.verse_line = 0
        return node

    def leave(self) -> None:
        self.stack.pop()["end"] = len(self.blocks)

    def add(self, src: dict, kind: str, text: str | None = None, **more) -> dict:
        box = {"page": src["page"], "x": src["x"], "y": src["y"], "w": src["right"] - src["x"], "h": src["size"]}
        block = {"block_id": f"b{len(self.blocks)}", "ord": len(self.blocks), "page": src["page"], "type": kind, "section": self.stack[-1]["section_id"], "text": src["text"] if text is None else text, "runs": tidy_runs([{**r, "page": src["page"]} for r in src["runs"]]), "boxes": [box], "pages": [src["page"]], "key": None, "system": None, "lemma": None, "line": None, "level": None, "group": None, "group_edge": None, **more}
        self.blocks.append(block)
        return block

    def append(self, block: dict, line: dict, text: str | None = None) -> None:
        """Run a line on at the end of a block."""
        text = line["text"] if text is None else text
        put = joiner(block["text"], text, self.compounds)
        runs = block["runs"]
        if put != " ":
            block["text"] = block["text"][:-1] if block["text"].endswith(("-", "‐")) else block["text"]
            if runs:
                runs[-1]["t"] = HYPHEN_END.sub("", runs[-1]["t"])
        if block["block_id"] not in self.squeezed:
            block["text"] = squeezed(block["text"])
            self.squeezed.add(block["block_id"])
        block["text"] = joined(block["text"], put + text)
        block["runs"] = run_on(runs, [*([{"t": put}] if put else []), *({**r, "page": line["page"]} for r in line["runs"])])
        block["boxes"].append({"page": line["page"], "x": line["x"], "y": line["y"], "w": line["right"] - line["x"], "h": line["size"]})
        if line["page"] not in block["pages"]:
            block["pages"].append(line["page"])

    def page(self, lines: list[dict], opened: list[dict], allowed) -> None:
        p = self.profile
        gaps = [line["gap"] for line in lines if 2 < line["gap"] < 60]
        leading = (first_mode(gaps, 0.5) if len(gaps) >= 4 else 0.0) or p.leading or 14.0
        near = [g for g in gaps if g < leading * 1.6]
        base = first_mode([line["x"] for line in lines], 1.0)
        wobble = min(6.0, 3 * upper_median([abs(g - leading) for g in near])), min(5.0, 3 * upper_median([abs(line["x"] - base) for line in lines if abs(line["x"] - base) < 12]))
        zone = zones(lines, p)
        first = True
        for k, line in enumerate(lines):
            if self._is_heading(line, k == 0, leading, wobble[0]):
                self._heading(line, opened)
            elif zone[k][0] and allowed(line):
                self._verse(line, lines[k - 1] if k else None, zone[k][1])
            else:
                self._prose(line, first, leading, wobble)
            first = False

    def _is_heading(self, line: dict, first: bool, leading: float, wobble: float) -> bool:
        text, p = line["text"].strip(), self.profile
        apart = first or line["gap"] >= leading * 1.3 - wobble
        if line["size"] > p.body * BIG and len(text) < 90 and apart and not NO_OPENING.match(text):
            hangs = bool(NO_END.search(text[-2:])) and not NUMERAL_HEAD.fullmatch(text)
            if not hangs or len(text) < 40:
                return True
        if not 3 <= len(line["text"]) <= 70:
            return False
        left, right = line["x"] - p.indent, p.right - line["right"]
        centred = min(left, right) > 25 and abs(left - right) < max(30.0, line["width"] * 0.06)
        return centred and not SMALL_LETTER.search(line["text"]) and bool(LARGE_LETTER.search(line["text"]))

    def _heading(self, line: dict, opened: list[dict]) -> None:
        self.open = None
        info = heading_of(line["text"])
        bare = lambda s: BARE.sub("", s.lower())
        known = any((o["number"] is not None and (o["number"], o["type"]) == (info["number"], info["type"])) or bare(o["title"]) == bare(info["title"]) for o in opened)
        node = self.stack[-1] if known else self.enter(info, line["page"], None)
        self.verse_line = 0
        self.add(line, "heading", level=node["depth"])

    def _verse(self, line: dict, above: dict | None, left: float) -> None:
        p, text, stated = self.profile, line["text"], None
        self.stack[-1]["verse"] = True
        self.open = None
        if line["x"] <= left - 10 and (m := re.fullmatch(r"([0-9]{1,4})\s+(.*)", text)):
            stated, text = int(m[1]), m[2]
        if not stated and line["right"] >= p.right - 12 and (m := re.fullmatch(r"(.*?)\s+([0-9]{1,4})", text)):
            stated, text = int(m[2]), m[1]
        turned = stated is None and line["x"] > left + 8 and line["right"] - line["x"] < p.width * 0.5 and above is not None and above["right"] >= p.right * 0.8 and not re.match(r"\(\s*[0-9]", line["text"])
        if turned and self.blocks and self.blocks[-1]["type"] == "verse-line":
            self.append(self.blocks[-1], line, text)
            return
        self.verse_line = stated if stated is not None else self.verse_line + 1
        block = self.add(line, "verse-line", text, line=self.verse_line)
        if stated is not None and block["runs"] and re.fullmatch(rf"\s*{stated}\s*", line["runs"][0]["t"]):
            block["runs"] = tidy_runs([{**r, "page": line["page"]} for r in line["runs"][1:]])

    def _prose(self, line: dict, first: bool, leading: float, wobble: tuple[float, float]) -> None:
        p, o = self.profile, self.open
        runs = line["runs"]
        keyed_run = len(runs) > 1 and bool(KEYED_RUN.fullmatch(runs[0]["t"])) and (runs[1]["em"] or runs[1]["f"] != runs[0]["f"] or runs[1]["t"][:1].isspace())
        entry = bool(ENTRY.match(line["text"])) or keyed_run
        if o is None or self._starts(line, o, first, entry, leading, wobble):
            self.open = {"block": self.add(line, "paragraph"), "left": line["x"], "rest": None, "right": line["right"], "entry": entry}
            return
        self.append(o["block"], line)
        o["right"] = line["right"]
        o["rest"] = line["x"] if o["rest"] is None else min(o["rest"], line["x"])

    def _starts(self, line: dict, o: dict, first: bool, entry: bool, leading: float, wobble: tuple[float, float]) -> bool:
        """Whether a line opens a new paragraph after the one that is open."""
        p, x = self.profile, line["x"]
        hanging = o["rest"] is None and 0 < x - o["left"] < 24 and (o["entry"] or o["right"] >= p.right - 14)
        measure = o["left"] if o["rest"] is None else o["rest"]
        indented = x > measure + INDENT + wobble[1] and not hanging
        solid = entry and x <= measure + 2 and (bool(HARD_KEY.match(line["text"])) or o["entry"])
        if first:
            return o["right"] < p.right - 14 or indented or entry
        ended = o["right"] < p.right - p.width * 0.12 and closes(o["block"]["text"])
        outdented = entry and o["rest"] is not None and x <= o["rest"] - 6
        return line["gap"] > leading + 2.5 + wobble[0] or indented or outdented or ended or solid


def _measure(block: dict) -> tuple[float, float, float]:
    b = block["boxes"]
    return upper_median([x["h"] for x in b]), min(x["x"] for x in b), max(x["x"] + x["w"] for x in b)


def embedded(blocks: list[dict], sections: list[dict], profile: Profile) -> None:
    """Mark lists, and regions set smaller or inset as letters (closed by a signature) or quotations; notes are left out."""
    tree = Tree(sections)
    free = [b["type"] == "paragraph" and not tree.in_apparatus(b["section"]) for b in blocks]

    def runs(test) -> list[tuple[int, int]]:
        out, k = [], 0
        while k < len(blocks):
            end = k
            while end < len(blocks) and test(end):
                end += 1
            if end > k:
                out.append((k, end))
            k = max(end, k + 1)
        return out

    def mark(k: int, end: int, kind: str, name: str) -> None:
        for i in range(k, end):
            edge = "only" if end - k == 1 else "start" if i == k else "end" if i == end - 1 else None
            blocks[i].update(type=kind, group=f"grp-{name}-{blocks[k]['block_id']}", group_edge=edge)

    for k, end in runs(lambda i: free[i] and bool(BULLET.match(blocks[i]["text"]) or ITEM.match(blocks[i]["text"]))):
        if end - k >= 2:
            mark(k, end, "list-item", "list")

    def inset(i: int) -> str | None:
        """strong, weak or None."""
        if not free[i] or blocks[i]["type"] != "paragraph":
            return None
        size, left, right = _measure(blocks[i])
        sides = (left > profile.left + profile.width * 0.04) + (right < profile.right - profile.width * 0.04)
        if 0 < size <= profile.body * 0.93:
            return "strong" if sides else "weak"
        return "strong" if sides == 2 else None

    for k, end in runs(lambda i: inset(i) is not None):
        if end - k == 1 and inset(k) != "strong":
            continue
        tail = blocks[end - 1]["text"].strip()
        lefts = [_measure(b)[1] for b in blocks[k:end]]
        name = NOT_SPELLED.sub("", tail)
        signed = end - k >= 2 and len(tail) < 70 and len(tail.split()) <= 8 and not BRACKET.match(tail) and not DIGIT.search(tail) and (lefts[-1] > min(lefts) + profile.width * 0.08 or (bool(name) and not SMALL_LETTER.search(name)))
        kind = "letter" if signed else "blockquote"
        mark(k, end, kind, kind)


WORD = "[A-Za-zÀ-ɏ]"
FUSED, HALF, SEEN = (11, 28), 3, 4
WORDS, LONG, HALVES = plain.compile("[a-zÀ-ɏ']+"), plain.compile(f"{WORD}{{{FUSED[0]},}}"), plain.compile(f"({WORD}{{2,}})[-‐] +([a-zÀ-ɏ]{{2,}})")


def _may_be_fused(blocks: list[dict], words: Counter[str], often: set[str]) -> bool:
    """Whether a long word, seen once at most, falls into two frequent ones; elsewhere pairs need not be counted."""
    longest = sorted((len(w) for w in often), reverse=True)[:1]
    if not longest or 2 * longest[0] < FUSED[0]:
        return False
    found = {w.lower() for block in blocks for r in block["runs"] for w in LONG.findall(r["t"])}
    return any(w[:k] in often and w[k:] in often for w in found if words[w] <= 1 for k in range(HALF, len(w) - HALF + 1))


def repair_words(blocks: list[dict], lines: list[dict], compounds: set[str] | None = None) -> list[tuple[str, str]]:
    """Part words that ran together and join words that a kept hyphen left in halves; what was changed, and into what.

    The document's own lines are the evidence: a long word seen once at most is parted where its halves stand side by
    side most often, four times at least; halves are joined if the whole word is printed and the two never are, neither
    side by side nor as a compound.
    """
    words = Counter(WORDS.findall("\n".join([line["text"] for line in lines]).lower()))
    # Most texts have no pair that often; only words that such a pair makes together are looked for. A pair that stands side
    # by side n times is no more frequent than either of its words.
    often = {w for w, n in words.items() if n >= SEEN and len(w) >= HALF}
    halved = any("- " in r["t"] or "‐ " in r["t"] for block in blocks for r in block["runs"])
    if not halved and not _may_be_fused(blocks, words, often):
        return []
    seqs = [WORDS.findall(line["text"].lower()) for line in lines]
    pairs: Counter[tuple[str, str]] = Counter(p for seq in seqs for p in zip(seq, seq[1:], strict=False) if p[0] in often and p[1] in often) if often else Counter()
    fused: dict[str, tuple[int, int]] = {}
    for (a, b), n in pairs.items():
        if n >= SEEN and FUSED[0] <= len(a) + len(b) <= FUSED[1]:
            fused[a + b] = max(fused.get(a + b, (0, 0)), (n, -len(a)))
    fused = {w: v for w, v in fused.items() if words[w] <= 1}
    done: list[tuple[str, str]] = []

    @cache
    def beside() -> set[tuple[str, str]]:
        return {p for seq in seqs for p in zip(seq, seq[1:], strict=False)}

    def part(m) -> str:
        w = m[0].lower()
        if w not in fused:
            return m[0]
        k = fused[w][1]
        done.append((m[0], f"{m[0][:-k]} {m[0][-k:]}"))
        return done[-1][1]

    compounds = compounds_of(lines) if compounds is None else compounds

    def join(m) -> str:
        a, b = m[1].lower(), m[2].lower()
        if not words[a + b] or f"{a}-{b}" in compounds or (a, b) in beside():
            return m[0]
        done.append((m[0], m[1] + m[2]))
        return done[-1][1]

    for block in blocks:
        before = len(done)
        for r in block["runs"]:
            if "- " in r["t"] or "‐ " in r["t"]:
                r["t"] = HALVES.sub(join, r["t"])
            if fused:
                r["t"] = LONG.sub(part, r["t"])
        if len(done) > before:
            block["text"] = " ".join("".join(r["t"] for r in block["runs"]).split())
    return done


def assemble(lines: list[dict], outline: list[dict] | None = None, title: str = "Document", allowed=lambda line: True, profile: Profile | None = None, finished: bool = True) -> tuple[list[dict], list[dict], Profile]:
    """(blocks, sections, profile) of one document's lines in reading order.

    lines carry page and width besides; outline: (title, page, depth) in order. allowed: which lines may be verse.
    Where only sections are asked for, blocks need not be finished: their words stay unrepaired, their regions unmarked.
    """
    profile = profile or Profile.of(lines)
    a = _Assembly(profile, compounds_of(lines), title)
    spine = [o for o in outline or [] if o["page"] is not None]
    pages: dict[int, list[dict]] = {}
    for line in lines:
        pages.setdefault(line["page"], []).append({"width": 0.0, **line})
    at = 0
    for page in sorted(pages):
        opened = []
        while at < len(spine) and spine[at]["page"] <= page:
            opened.append(heading_of(spine[at]["title"]))
            a.enter(opened[-1], page, spine[at]["depth"])
            at += 1
        a.page(pages[page], opened, allowed)
    while a.stack:
        a.leave()
    if finished:
        repair_words(a.blocks, lines, a.compounds)
        embedded(a.blocks, a.sections, profile)
    for s in a.sections:
        s.pop("spine")
    assert all(b["type"] in PROSE | {"heading", "verse-line"} for b in a.blocks)
    return a.blocks, a.sections, profile

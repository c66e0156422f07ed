"""References: links, note markers, line keys, phrases, internal references and citations; then one decision on each.

Detectors only propose. A proposal has a block, a range, signals, a destination (a block or a section) or none, rival
candidates and a confidence; quire.functions.numerals.SIGNALS says what signals are worth. Proposals depend on a
document's order (notes are used up in turn), so they are made document by document; what competes for the same
characters competes within a block.
"""

from __future__ import annotations

import math
import re as plain
from collections import defaultdict
from collections.abc import Iterator

import regex as re

from quire.functions.numerals import ACCEPT_RESOLVED, KEEP_UNRESOLVED, SIGNALS
from quire.functions.spans import disjoint, is_marker, literal_span, marker_span, opening_span, phrase_span, sentence_at, snapped, words_of
from quire.operators.content import number
from quire.operators.systems import GLUED, Tree, census, marker_class, marker_key

# Forms of references and the words that announce them.
BRACKET_MARK = re.compile(r"\[\s?([0-9]{1,3}|\*{1,3}|†{1,3}|‡{1,3})\s?\]")
PAREN_MARK = re.compile(r"(?<=[\p{L}.,;:!?'\"’”])\s?(\(([0-9]{1,3})\))(?![\p{L}\p{N}])")
FORMULA = re.compile(r"\s*[=+×÷^<>]|\s*[-−]\s*[0-9]")
CITATION = re.compile(r"\(([A-Z][\w'’-]+)[^)]{0,40}?(?<![A-Za-z0-9_])(1[6-9][0-9]{2}|20[0-9]{2})[a-z]?\)")
CUE = re.compile(r"(?:(?<![A-Za-z0-9_])(?:see(?:\s+also)?|cf\.?|compare|refer(?:red)?\s+to|(?:as\s+)?(?:discussed|described|shown|given|listed|explained|noted|treated)\s+(?:in|at|on)|(?:set\s+out|reproduced|printed)\s+in)\s*|\(\s*)$", re.IGNORECASE)
LIST = re.compile(r"(?:,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+|;\s*)$", re.IGNORECASE)
DIVISION = re.compile(
    r"(?<![\w])(Chapters?|Chap\.|Ch\.|Books?|Volumes?|Vol\.|Parts?|Sections?|Sect\.|Sec\.|§|Appendix|Appendices|Cantos?|Acts?|Figures?|Figs?\.|Tables?)\s*"
    r"([0-9]{1,3}(?:\.[0-9]{1,4})*|[IVXLCDM]{1,7}|[A-Z])(?![\w])(?:\s*[–-]\s*[0-9]{1,4})?(?:,?\s*(?:lines?|ll?\.)\s*([0-9]{1,4})(?:\s*[–-]\s*[0-9]{1,4})?)?(?:\s*ff?\.)?",
    re.IGNORECASE,
)
PAGE = re.compile(r"(?<![\w])(pp?\.)\s?([0-9]{1,4})(?:\s*[–-]\s*[0-9]{1,4})?(?:\s*ff?\.)?", re.IGNORECASE)
LOCUS = re.compile(r"(?<![\w.])(?:([0-9]{1,2})\.([0-9]{1,4})(?:\s*[–-]\s*[0-9]{1,4})?(?:\s*ff?\.)?|([0-9]{1,4})\s*ff?\.)(?![\w])")
NOTE_ON = re.compile(r"(?<![A-Za-z0-9_])notes?\s+(?:on|to|at)\s+((?:ll?\.\s*|lines?\s+)?[\w.]*\w)", re.IGNORECASE)
DIRECTION = re.compile(r"(?<![A-Za-z0-9_])see\s+(above|below|earlier|later)(?![A-Za-z0-9_])", re.IGNORECASE)
# What stands somewhere in a text that one of these forms is in, in small letters; cheap to look for first. They
# do not hold for the three signs that stand for an ASCII letter where case is ignored.
ODD_LETTERS = "\u0130\u017f\u212a"
HINTS = {DIVISION: ("chap", "ch.", "book", "vol", "part", "sect", "sec.", "§", "append", "canto", "act", "fig", "table"), PAGE: ("p.",), NOTE_ON: ("note",), DIRECTION: ("see",)}
DIGIT = plain.compile("[0-9]")
#: A division's word with what may follow it up to its numeral's first sign.
DIVIDED = plain.compile(r"(?:chapters?|chap\.|ch\.|books?|volumes?|vol\.|parts?|sections?|sect\.|sec\.|§|appendix|appendices|cantos?|acts?|figures?|figs?\.|tables?)\s*(?:[0-9]|[ivxlcdm]{1,7}(?![a-z0-9_])|[a-z](?![a-z0-9_]))")
# Fixed values, for may_refer: what the forms above cannot do without, wide enough for whatever joining lines and mending words make.
_LETTER = "A-Za-zÀ-ɏ"
_TOLD = "discussed|described|shown|given|listed|explained|noted|treated"
_WORDS = ("chapter", "chap.", "ch.", "book", "volume", "vol.", "part", "section", "sect.", "sec.", "§", "appendix", "appendices", "canto", "act", "figure", "fig", "table")
#: A division's word and its numeral; of "ch." alone repair makes no word of its own, for halves have three letters.
NAMED = tuple((w, plain.compile(rf"{f'(?<![{_LETTER}0-9_])' if w == 'ch.' else ''}(?i:{plain.escape(w)}s?)\.?\s*(?:[0-9]|[IVXLCDM]{{3}}|[A-Z]{{1,2}}(?![{_LETTER}0-9_]))")) for w in _WORDS)
PAGED, NOTED, SHOWN = plain.compile(rf"(?<![{_LETTER}0-9_])pp?\.\s*[0-9]"), plain.compile(r"notes?\s+(?:on|to|at)"), plain.compile(r"see\s+(?:above|below|earlier|later)")
PLACED = plain.compile(r"[0-9](?:\.[0-9]|\s*f)")
CUED = plain.compile(rf"(?:\(|see|also|cf\.?|compare|refer(?:red)?\s+to|(?:{_TOLD})\s+(?:in|at|on)|(?:out|reproduced|printed)\s+in)\s*[0-9]")
OPENED, BROKEN = plain.compile(r"\[\s*(?:[0-9*†‡]|$)", plain.MULTILINE), plain.compile("[-‐]\\s+[a-zÀ-ɏ]")
#: What a line may open with that makes an entry or a host of notes.
OPENING = plain.compile(rf"\s*(?:[*†‡§¶]|(?i:explanatory|notes?|endnotes|commentary|bibliography|works|further|suggestions|glossary|abbreviations|textual)(?![{_LETTER}]))")
#: What may end a line and run on over its end: a form's beginning, a word parted by a hyphen or after two letters. Verse may lose a number there.
ENDING = plain.compile(
    rf"(?:\[|\(|[-‐]|(?i:chap(?:ter|\.)|books?|vol(?:ume|\.)|parts?|sect?(?:ion|\.)|appendi(?:x|ces)|cantos?|acts?|fig(?:ure|s?\.)|tables?|notes?(?:\s(?:on|to|at))?|see|also|cf\.?|compare|refer(?:red)?(?:\sto)?|(?:{_TOLD})(?:\s(?:in|at|on))?|set|(?:out|reproduced|printed)(?:\sin)?)s?"
    rf"|§|(?<![{_LETTER}0-9_])(?i:ch\.|pp?\.)|(?<![A-Za-z’'])(?=[A-Za-z’'])[’']*(?:[A-Za-z][’']*){{0,2}})(?:\s?[0-9]{{1,4}}){{0,2}}$"
)
DOTTED = ("chap.", "ch.", "vol.", "sect.", "sec.", "fig.", "figs.", "p.", "cf.")
STEMS = (("chap", "chapter"), ("ch.", "chapter"), ("book", "book"), ("vol", "volume"), ("part", "part"), ("sec", "section"), ("§", "section"), ("append", "appendix"), ("canto", "chapter"), ("act", "chapter"), ("fig", "figure"), ("tab", "table"))
MARKED = {"sequential", "bracketed", "symbol", "alphabetic", "roman"}
NOTES = {"note", "footnote", "endnote", "editorial-note", "translator-note", "author-note", "commentary", "glossary"}
BY_KIND = {"line-commentary": "line-note", "footnote": "footnote", "endnote": "endnote", "textual-apparatus": "textual-note", "bibliography": "bibliography", "glossary": "glossary", "appendix": "appendix", "translator-note": "translator-note", "editorial-note": "editorial-note"}
PHRASE, NEAR_LINES = 0.85, 4


def type_of(system: dict | None) -> str:
    """What kind of reference leads to a system's entries."""
    if system is None:
        return "note"
    low = system["label"].lower()
    return next((t for w, t in (("translat", "translator-note"), ("author", "author-note"), ("editor", "editorial-note")) if w in low), BY_KIND.get(system["kind"], "note"))


def _held(word: str, low: str) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + 1)


def _runs_on(line: str) -> bool:
    """Whether a line's end may belong with what follows; no more than its last six words are asked for."""
    end = line.rstrip()
    if end.endswith(".") and not end[-6:].lower().endswith(DOTTED):
        return False
    return bool(ENDING.search(" ".join(end.rsplit(None, 6)[-6:])[-80:]))


def may_refer(text: str) -> bool:
    """Whether anything may be proposed in a text set as plain lines: of one size and one left edge, so without raised keys and
    headings, and without links of a file. False only where `references` finds nothing, whichever lines are furniture and however
    the others are joined and mended; true far less often than a document need be assembled to know."""
    if any(c in text for c in ODD_LETTERS) or ("[" in text and OPENED.search(text)) or (("-" in text or "‐" in text) and BROKEN.search(text)):
        return True
    low = text.lower()
    if any(form.match(text, at) for word, form in NAMED for at in _held(word, low)):
        return True
    if any(hint in low and form.search(low) for hint, form in (("p.", PAGED), ("note", NOTED), ("see", SHOWN))) or (PLACED.search(text) and CUED.search(low)):
        return True
    return any(OPENING.match(line) or _runs_on(line) for line in text.split("\n"))


class Document:
    """One document's blocks, sections, systems and entries, with the look-ups that detectors share."""

    def __init__(self, blocks, sections, systems, entries, links=(), page_map=()):
        self.blocks, self.sections, self.systems, self.entries = blocks, sections, {s["system_id"]: s for s in systems}, entries
        self.links, self.page_map = list(links), list(page_map)
        self.tree = Tree(sections)
        self.by_id = {b["block_id"]: b for b in blocks}
        self.boxes: dict[int, list[tuple[dict, dict]]] = defaultdict(list)
        for b in blocks:
            for box in b.get("boxes") or []:
                self.boxes[box["page"]].append((b, box))
        self.body = [b for b in blocks if not self.tree.in_apparatus(b["section"])]
        self.census = census(blocks, self.tree)
        self.proposals: list[dict] = []
        self.lines: dict[int | None, list[dict]] = defaultdict(list)
        for b in blocks:
            if b["type"] == "verse-line" and b["line"] is not None:
                self.lines[b["line"]].append(b)

    def propose(self, block: dict, start: int, end: int, *, kind: str, method: str, confidence: float, signals: list[str], to=None, to_section=None, system=None, key=None, exact=False, candidates=(), ambiguous=False, link=None, note=None) -> None:
        text = block["text"]
        start = max(0, min(start, len(text)))
        end = min(len(text), max(start, end))
        s = sentence_at(text, start)
        self.proposals.append({"ref_id": f"r{len(self.proposals)}", "type": kind, "system": system, "from": block["block_id"], "start": start, "end": end, "source_text": text[start:end], "sentence_start": s[0], "sentence_end": s[1], "key": text[start:end] if key is None else key, "to": to, "to_section": to_section, "method": method, "confidence": confidence, "signals": list(signals), "exact": exact, "candidates": list(candidates), "ambiguous": ambiguous, "provenance": "explicit-link" if link is not None else "inferred", "url": (link or {}).get("url"), "note": note})

    # -- links of the file -------------------------------------------------------------------------------------------

    def destination(self, page: int, y: float | None, anchor: str) -> dict | None:
        """The block at a place: the one whose box holds it, else the first below, else the next page's first; an entry
        among the next three that has the anchor's own key goes before."""
        from_top = lambda p: sorted(self.boxes.get(p, []), key=lambda c: -(c[1]["y"] + c[1]["h"]))
        here = from_top(page)
        if not here:
            return None
        at = 0
        if y is not None:
            inside = next((k for k, (_, c) in enumerate(here) if c["y"] - 2 <= y <= c["y"] + c["h"] + 2), None)
            below = next((k for k, (_, c) in enumerate(here) if c["y"] + c["h"] <= y + 2), None)
            if inside is None and below is None and self.boxes.get(page + 1):
                here = from_top(page + 1)
            else:
                at = inside if inside is not None else below if below is not None else len(here) - 1
        key = marker_key(anchor) if anchor and is_marker(anchor) else ""
        keyed = next((b for b, _ in here[at : at + 3] if key and b["type"] == "entry" and marker_key(b["key"] or "") == key), None)
        return keyed or here[at][0]

    def find_links(self) -> None:
        for link in self.links:
            source = next((b for b, c in self.boxes.get(link["page"], []) if link["y"] - 3 <= c["y"] <= link["y"] + link["h"] + 3 and c["x"] < link["x"] + link["w"] + 2 and c["x"] + c["w"] > link["x"] - 2), None)
            if source is None:
                continue
            text, anchor = source["text"], (link.get("text") or "").strip()
            exact = (marker_span(text, anchor) if anchor and is_marker(anchor) else None) or literal_span(text, anchor)
            span = exact
            if span is None:
                loose = phrase_span(text, anchor) if anchor else opening_span(text, 6)
                span = snapped(text, loose[0], loose[1], False) if loose else None
            if span is None:
                continue
            page = link.get("dest_page")
            to = self.destination(page, link.get("dest_y"), anchor) if page is not None and not link.get("url") else None
            section = None
            if to is None and page is not None:
                near = [s for s in self.sections if s["type"] != "root" and s["page"] <= page]
                section = max(enumerate(near), key=lambda k: (k[1]["page"], k[0]))[1]["section_id"] if near else None
            kind = "external" if link.get("url") else type_of(self.systems.get(to["system"])) if to and to["type"] == "entry" else "structural-navigation" if to or section else "hyperlink"
            self.propose(source, *span, kind=kind, method="link", confidence=0.99 if to or link.get("url") else 0.7, signals=["explicit-link"], to=to and to["block_id"], to_section=section, system=to and to["system"], key=anchor or None, exact=exact is not None, link=link)

    # -- note markers ------------------------------------------------------------------------------------------------

    def markers(self, block: dict, keys: set[str]) -> list[dict]:
        """Candidate markers of a block; of overlapping ones the first kind found stays: raised, bracketed, in parentheses, glued."""
        text, found = block["text"], []

        def add(key: str, start: int, end: int, signal: str, sure: bool, *more: str) -> None:
            if not any(start < f["end"] and f["start"] < end for f in found):
                math = ["math-context"] if signal in ("superscript", "bracketed") and FORMULA.match(text[end : end + 4]) else []
                found.append({"key": key, "start": start, "end": end, "sure": sure, "signals": [signal, *math, *more]})

        at = 0
        for r in block["runs"]:
            start, end = at + len(r["t"]) - len(r["t"].lstrip()), at + len(r["t"].rstrip())
            at += len(r["t"])
            key = marker_key(r["t"]) if r.get("sup") else ""
            cls = marker_class(key) if key else None
            if cls and (cls in ("numeric", "symbol") or key in keys):
                if start and text[start - 1 : start] in "[({<" and text[end : end + 1] == "])}>"["[({<".index(text[start - 1])]:
                    start, end = start - 1, end + 1
                alone = ["isolated-typography"] if cls == "numeric" and self.census["usage"]["superscript"]["numeric"] < 2 else []
                add(key, start, end, "superscript", cls in ("numeric", "symbol"), *alone)
        for m in BRACKET_MARK.finditer(text):
            add(marker_key(m[0]), *m.span(), "bracketed", True)
        if "parenthesized" in self.census["confirmed"]:
            for m in PAREN_MARK.finditer(text):
                if m[2] in keys:
                    add(m[2], *m.span(1), "parenthesized", False)
        for m in GLUED.finditer(text):
            if m[1] in keys:
                add(m[1], *m.span(1), "glued-symbol", False)
        return sorted(found, key=lambda f: f["start"])

    def find_markers(self) -> None:
        """Match each marker with the entry of its key that fits best: by page for footnotes, by division, and in turn."""
        index: dict[str, list[dict]] = defaultdict(list)
        for e in self.entries:
            if self.systems[e["system"]]["grammar"] in MARKED:
                index[marker_key(e["key"])].append(e)
        used: dict[str, int] = defaultdict(lambda: -1)
        linked = [(p["from"], p["start"], p["end"]) for p in self.proposals if p["provenance"] == "explicit-link"]
        for b in self.body:
            if b["type"] in ("heading", "entry"):
                continue
            here = self.tree.scope(b["section"])
            for m in self.markers(b, set(index)):
                if any(f == b["block_id"] and m["start"] < e and s < m["end"] for f, s, e in linked):
                    continue
                scored = []
                for e in index.get(m["key"], []):
                    target = self.by_id[e["block_id"]]
                    score, there = 1, self.tree.scope(e["section"])
                    if self.systems[e["system"]]["kind"] == "footnote":
                        score += {0: 4, 1: 2}.get(target["page"] - b["page"], -6) - 4 * (target["ord"] < b["ord"])
                    for level, good, bad in (("chapter", 3, -5), ("volume", 2, -4), ("book", 2, -4)):
                        if here[level] is not None and there[level] is not None:
                            score += good if here[level] == there[level] else bad
                    ahead = [self.by_id[x["block_id"]]["ord"] for x in index[m["key"]] if x["system"] == e["system"] and self.by_id[x["block_id"]]["ord"] > used[e["system"]]]
                    due = target["ord"] == min(ahead, default=None)
                    scored.append((score + 2 * due, e, due))
                best = max(scored, key=lambda s: s[0], default=None)
                if best and best[0] > 0:
                    top = [s for s in scored if s[0] == best[0]]
                    e = best[1]
                    used[e["system"]] = max(used[e["system"]], self.by_id[e["block_id"]]["ord"])
                    rivals = [{"to": x["block_id"], "key": x["key"], "score": s} for s, x, _ in top] if len(top) > 1 else []
                    self.propose(b, m["start"], m["end"], kind=type_of(self.systems[e["system"]]), method="marker", confidence=0.5 if rivals else 0.97 if best[0] >= 4 else 0.75, signals=[*m["signals"], "system-key", *(["sequence"] if best[2] else [])], to=e["block_id"], system=e["system"], key=m["key"], exact=True, candidates=rivals, ambiguous=bool(rivals))
                elif m["sure"]:
                    self.propose(b, m["start"], m["end"], kind="note", method="unresolved", confidence=0.2, signals=m["signals"], key=m["key"], exact=True, candidates=[{"to": x["block_id"], "key": x["key"], "score": s} for s, x, _ in scored])

    # -- notes keyed by line or phrase ---------------------------------------------------------------------------------

    def find_line_keys(self) -> None:
        """Tie entries keyed by verse lines to their lines: by number within the division, else the nearest line; the
        lemma within four lines says which, and where."""
        verse = [(self.tree.scope(b["section"])["book"], b) for b in self.blocks if b["type"] == "verse-line" and b["line"] is not None]
        for e in self.entries:
            system = self.systems[e["system"]]
            if system["grammar"] not in ("line-keyed", "book-line") or e["numeric"] is None:
                continue
            book = self.tree.scope(e["section"])["book"]
            pool = [b for k, b in verse if k == book] or ([b for _, b in verse] if book is None else [])
            if not pool:
                continue
            line = min(pool, key=lambda b: (abs(b["line"] - e["numeric"]), b["ord"]))
            span, like = None, 0.0
            if e["lemma"]:
                for b in sorted((b for b in pool if abs(b["line"] - e["numeric"]) <= NEAR_LINES), key=lambda b: abs(b["line"] - e["numeric"])):
                    found = phrase_span(b["text"], e["lemma"])
                    if found and found[2] > like:
                        line, span, like = b, found[:2], found[2]
            exact = line["line"] == e["numeric"]
            span = span or opening_span(line["text"])
            if span:
                self.propose(line, *span, kind="line-note", method="line-key", confidence=0.95 if exact and like >= 0.5 else 0.8 if exact else 0.5, signals=["line-key", *(["lemma"] if like >= 0.5 else [])], to=e["block_id"], system=e["system"], key=e["key"])

    def find_phrases(self) -> None:
        """Tie entries keyed by phrases to the first place after the last one where the text has the phrase."""
        readable = [b for b in self.body if b["type"] not in ("heading", "entry")]
        cursor: dict[str, int] = defaultdict(lambda: -1)
        keyed = [e for e in self.entries if self.systems[e["system"]]["grammar"] == "lemma-keyed" and e["lemma"]]
        holding: dict[str, set[int]] = defaultdict(set)
        for i, b in enumerate(readable if keyed else ()):
            for w in words_of(b["text"]).places:
                holding[w].add(i)
        for e in keyed:
            # So long a run of a phrase holds the words in its middle: only blocks with all of them are searched.
            words = words_of(e["lemma"]).words
            least = math.ceil(len(words) * PHRASE - 1e-9)
            middle = sorted((holding.get(w, set()) for w in words[len(words) - least : least]), key=len)
            hits = [(b, f) for b in map(readable.__getitem__, sorted(set.intersection(*middle) if middle else ())) if (f := phrase_span(b["text"], e["lemma"])) and f[2] >= PHRASE]
            if not hits:
                continue
            b, f = next((h for h in hits if h[0]["ord"] >= cursor[e["system"]]), hits[0])
            cursor[e["system"]] = b["ord"]
            self.propose(b, f[0], f[1], kind=type_of(self.systems[e["system"]]), method="lemma-match", confidence=0.9 if len(hits) == 1 else 0.7, signals=["lemma"], to=e["block_id"], system=e["system"], key=e["key"], candidates=[{"to": h["block_id"], "key": e["key"], "score": g[2]} for h, g in hits[:6]] if len(hits) > 1 else [])

    def find_citations(self) -> None:
        """Tie (Surname … year) to the first bibliography entry of that surname and year."""
        books = [(e, *e["key"].rsplit(" ", 1)) for e in self.entries if self.systems[e["system"]]["grammar"] == "author-date"]
        for b in self.blocks:
            if not books or b["type"] in ("heading", "entry"):
                continue
            for m in CITATION.finditer(b["text"]):
                hit = next((e for e, name, year in books if name.lower().startswith(m[1].lower()) and year == m[2]), None)
                if hit:
                    self.propose(b, *m.span(), kind="bibliography", method="author-date", confidence=0.9, signals=["author-date"], to=hit["block_id"], system=hit["system"], key=f"{m[1]} {m[2]}")

    # -- references in words ---------------------------------------------------------------------------------------------

    def find_internal(self) -> None:
        captions = [b for b in self.blocks if b["type"] in ("caption", "heading")]
        keyed = defaultdict(list)
        for b in self.blocks:
            if b["type"] == "entry" and b["key"]:
                keyed[b["key"]].append(b)
        for b in self.blocks:
            if b["type"] == "heading":
                continue
            found: list[dict] = []
            text = b["text"]
            scope = {s["section_id"] for s in self.tree.path(b["section"])}

            def cue(at: int, text=text, found=found) -> list[str]:
                if CUE.search(text[max(0, at - 32) : at]):
                    return ["cue"]
                ends = [f["end"] for f in found if f["end"] <= at]
                m = LIST.search(text, max(ends), at) if ends else None
                return ["cued-list"] if m and any(f["end"] == m.start() for f in found) else []

            low = text.lower()
            odd = any(c in text for c in ODD_LETTERS)
            seek = lambda form, text=text, low=low, odd=odd: form.finditer(text) if odd or any(h in low for h in HINTS[form]) else ()

            for m in seek(DIVISION) if odd or DIVIDED.search(low) else ():
                self._division(m, cue(m.start()), captions, scope, found)
            for m in seek(PAGE):
                printed = [p for p in self.page_map if p["printed"] == int(m[2])]
                arabic = [p for p in printed if not p["roman"]]
                entry = arabic[0] if len(arabic) == 1 else printed[0] if printed and not arabic else None
                target = entry and next((x for x in self.blocks if x["page"] == entry["page"]), None)
                found.append({"start": m.start(), "end": m.end(), "kind": "page-reference", "method": "page-map" if entry else "unresolved", "confidence": (0.85 if target else 0.5) if entry else 0.3, "signals": [*cue(m.start()), "intrinsic-form"], "to": target and target["block_id"], "ambiguous": len(arabic) > 1, "candidates": [{"to": x["block_id"], "key": m[0], "score": 50} for p in arabic for x in self.blocks if x["page"] == p["page"]][:6] if len(arabic) > 1 else []})
            for m in seek(NOTE_ON):
                key = re.sub(r"\.$", "", re.sub(r"^(?:ll?\.\s*|lines?\s+)", "", m[1], flags=re.IGNORECASE))
                names = bool(re.search("[0-9]", key)) or marker_class(key) is not None
                pool = keyed[key] if names else []
                found.append({"start": m.start(), "end": m.end() - m[1].endswith("."), "kind": "note", "key": key, **self._one(pool, key), "signals": [*cue(m.start()), "intrinsic-form" if names else "vocabulary-only"], "method": "heuristic" if len(pool) == 1 else "unresolved", "confidence": 0.85 if len(pool) == 1 else 0.3})
            for m in LOCUS.finditer(text) if DIGIT.search(text) else ():
                said = cue(m.start())
                if not said:
                    continue
                if m[1]:
                    spans = [(s["start"], s["end"]) for s in self.sections if s["type"] in ("book", "chapter") and s["number"] == int(m[1])]
                    pool = [x for x in self.lines[int(m[2])] if any(a <= x["ord"] < e for a, e in spans)]
                else:
                    pool = self.lines[int(m[3])]
                    own = [x for x in pool if any(s["section_id"] in scope and s["type"] != "root" for s in self.tree.path(x["section"]))]
                    pool = own if len(pool) > 1 and len(own) == 1 else pool
                if pool or said == ["cue"]:
                    found.append({"start": m.start(), "end": m.end(), "kind": "cross-reference", **self._one(pool, m[0]), "signals": said, "method": "line-key" if len(pool) == 1 else "unresolved", "confidence": 0.8 if len(pool) == 1 else 0.3})
            for m in seek(DIRECTION):
                found.append({"start": m.start(), "end": m.end(), "kind": "cross-reference", "method": "unresolved", "confidence": 0.3, "signals": ["cue"]})
            last = 0
            for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
                if f["start"] >= last:
                    last = f["end"]
                    self.propose(b, f.pop("start"), f.pop("end"), **f)

    @staticmethod
    def _one(pool: list[dict], key: str) -> dict:
        return {"to": pool[0]["block_id"] if len(pool) == 1 else None, "ambiguous": len(pool) > 1, "candidates": [{"to": x["block_id"], "key": key, "score": 50} for x in pool[:6]] if len(pool) > 1 else []}

    def _division(self, m, said: list[str], captions: list[dict], scope: set[str], found: list[dict]) -> None:
        word, numeral = m[1], m[2]
        kind = next(k for stem, k in STEMS if word.lower().startswith(stem))
        capital = bool(re.match("[A-Z§]", word))
        if re.search("[a-z]", numeral) or not (capital or said):
            return
        signals = [*said, *(["capitalized-label"] if capital else [])]
        base = {"start": m.start(), "end": m.end(), "key": m[0].strip()}
        if kind in ("figure", "table"):
            name = r"fig(?:ure)?\.?" if kind == "figure" else "table"
            pool = [c for c in captions if re.match(rf"{name}\s*{re.escape(numeral)}(?![\w.]*[0-9])", c["text"].strip(), re.IGNORECASE)]
            if pool or said:
                found.append({**base, "kind": kind, **self._one(pool, base["key"]), "signals": signals + ["named-node-exists"] * bool(pool), "method": "heuristic" if len(pool) == 1 else "unresolved", "confidence": 0.85 if len(pool) == 1 else 0.4 if pool else 0.3})
            return
        dotted = "." in numeral and kind != "section"
        n = number(numeral.split(".")[0] if dotted else numeral)
        pool = [s for s in self.sections if s["type"] == kind and ((n is not None and s["number"] == n) or s["label"].upper().endswith(f" {numeral}") or s["title"].upper() == numeral)]
        if not pool and not said:
            return
        own = [s for s in pool if s["parent"] in scope]
        hit = pool[0] if len(pool) == 1 else own[0] if len(own) == 1 else None
        head = lambda s: next((b["block_id"] for b in self.blocks[s["start"] : s["start"] + 1]), None)
        line_no = int(numeral.split(".")[1]) if dotted else int(m[3]) if m[3] else None
        to = head(hit) if hit else None
        if hit and line_no is not None:
            to = next((x["block_id"] for x in self.lines[line_no] if hit["start"] <= x["ord"] < hit["end"]), to)
        rivals = [{"to": head(s) or s["section_id"], "key": base["key"], "score": 50} for s in pool[:6]] if pool and hit is None else []
        kind_of = "cross-reference" if line_no is not None else "appendix" if kind == "appendix" else "structural-navigation"
        found.append({**base, "kind": kind_of, "to": to, "to_section": hit and hit["section_id"], "signals": signals + ["named-node-exists"] * bool(pool), "method": ("line-key" if line_no is not None else "heuristic") if hit else "unresolved", "confidence": (0.9 if said else 0.75) if hit else 0.4 if rivals else 0.3, "candidates": rivals, "ambiguous": bool(rivals)})

    # -- decisions ---------------------------------------------------------------------------------------------------

    def valid(self, c: dict) -> float:
        """How far a proposal's destination fits it; 0 where it does not."""
        if c["url"]:
            return 0.99
        dest = self.by_id.get(c["to"]) if c["to"] else None
        if (c["to"] and dest is None) or (c["to_section"] and c["to_section"] not in self.tree.by_id) or not (c["to"] or c["to_section"]):
            return 0.0
        base = min(1.0, 0.5 if c["ambiguous"] else c["confidence"])
        entry = dest is not None and dest["type"] == "entry"
        if c["method"] == "marker":
            return base if entry and (not c["system"] or c["system"] in self.systems) and marker_key(dest["key"] or "") == marker_key(str(c["key"] or "")) else 0.0
        if c["provenance"] == "explicit-link":
            if entry and re.fullmatch(r"[\[(]?[\w*†‡§¶]{1,4}[\])]?", c["source_text"].strip()):
                return 0.99 if marker_key(dest["key"] or "") == marker_key(c["source_text"]) else 0.8
            return 0.95
        if c["type"] in NOTES and c["method"] not in ("line-key", "lemma-match") and not entry:
            return 0.0
        if c["type"] == "structural-navigation" and not c["to_section"] and (dest is None or dest["type"] != "heading"):
            return 0.0
        return base


def recognition(signals: list[str]) -> float:
    doubt = 1.0
    for s in signals:
        doubt *= 1 - max(0.0, SIGNALS[s])
    objection = max([0.0, *(-SIGNALS[s] for s in signals)])
    return int((1 - doubt) * (1 - objection) * 1000 + 0.5) / 1000


def reconcile(doc: Document) -> tuple[list[dict], list[dict]]:
    """(edges, log): the proposals that stand, ranges disjoint, and one row on every proposal with its decision."""
    log, kept = {}, []

    def note(c: dict, score: float, dest: float, decision: str, reason: str) -> None:
        log[c["ref_id"]] = {"ref_id": c["ref_id"], "block_id": c["from"], "start": c["start"], "end": c["end"], "method": c["method"], "type": c["type"], "signals": c["signals"], "recognition": score, "destination": c["to"] or c["to_section"], "destination_confidence": dest, "decision": decision, "reason": reason}

    for c in doc.proposals:
        score, dest = recognition(c["signals"]), doc.valid(c)
        if dest > 0:
            ok = score >= ACCEPT_RESOLVED
            note(c, score, dest, "accepted" if ok else "rejected", "destination-fits" if ok else "weak-recognition")
        elif c["ambiguous"] and len(c["candidates"]) >= 2 and score >= ACCEPT_RESOLVED:
            ok = True
            note(c, score, 0.0, "accepted-unresolved", "ambiguous")
        else:
            ok = score >= KEEP_UNRESOLVED
            lost = c["to"] or c["to_section"]
            note(c, score, 0.0, "accepted-unresolved" if ok else "rejected", ("destination-rejected" if lost else "no-destination") if ok else "weak-recognition")
            if ok and lost:
                c = {**c, "to": None, "to_section": None, "method": "unresolved", "system": None, "confidence": min(c["confidence"], 0.3), "candidates": [*c["candidates"], {"to": lost, "key": c["key"], "score": 0}]}
        if ok:
            kept.append({**c, "score": score, "dest": dest})
    # The stronger keeps the characters: links of the file, then a destination that fits, then the sum of both scores.
    kept.sort(key=lambda c: -((10 if c["provenance"] == "explicit-link" else 0) + (2 if c["dest"] > 0 else 0) + c["score"] + c["dest"]))
    final: dict[str, list[dict]] = defaultdict(list)
    for c in kept:
        goal = c["to"] or c["to_section"]
        both = lambda f, c=c, goal=goal: f["provenance"] == c["provenance"] == "explicit-link" and (f["to"] or f["to_section"]) != goal
        rival = next((f for f in final[c["from"]] if f["start"] < c["end"] and c["start"] < f["end"] and not both(f)), None)
        if rival is None:
            final[c["from"]].append(c)
        elif (rival["start"], rival["end"]) == (c["start"], c["end"]) or (rival["to"] or rival["to_section"]) == goal:
            rival["signals"] = [*rival["signals"], *c["signals"]]
            rival["system"] = rival["system"] or c["system"]
            note(c, c["score"], c["dest"], "merged", f"same-as {rival['ref_id']}")
        else:
            note(c, c["score"], c["dest"], "rejected", f"overlaps {rival['ref_id']}")
    edges = []
    for block, own in final.items():
        own = [{**c, "signals": list(dict.fromkeys(c["signals"]))} for c in own]
        edges += disjoint(own, doc.by_id[block]["text"])
    edges.sort(key=lambda c: (doc.by_id[c["from"]]["ord"], c["start"]))
    return edges, [log[c["ref_id"]] for c in doc.proposals]


def references(blocks, sections, systems, entries, links=(), page_map=()) -> tuple[list[dict], list[dict]]:
    """(edges, log) of one document, by all detectors."""
    doc = Document(blocks, sections, systems, entries, links, page_map)
    for find in (doc.find_links, doc.find_markers, doc.find_line_keys, doc.find_phrases, doc.find_internal, doc.find_citations):
        find()
    return reconcile(doc)

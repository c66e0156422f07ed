"""Note systems: keyed entries and their marker classes, host headings, page footnotes, marker usage, system profiles.

Blocks are dicts (block_id, ord, page, type, section, text, runs, key, system, lemma); sections (section_id, type, label,
number, title, page, parent, depth, start, end), their blocks being ord start..end-1. What depends on a document's whole
course is decided for one document at a time; Spark parts the documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import regex as re

PROSE = {"paragraph", "blockquote", "letter", "list-item"}
SYMBOLS = r"\*{1,3}|†{1,3}|‡{1,3}|§{1,3}|¶{1,3}"

# How keys are printed at the head of an entry, and what headings host notes.
SYMBOL_ENTRY = re.compile(rf"({SYMBOLS})\s*([^\s*†‡§¶].*)", re.DOTALL)
KEYED_ENTRY = re.compile(r"\[?\s*([0-9]{1,4}(?:[–-][0-9]{1,4})?(?:ff?\.)?(?:\s*[a-z])?)\s*[\].):]?\s+(\S.*)", re.DOTALL)
LETTERED_ENTRY = re.compile(r"[(\[]?([a-z]|[ivxlc]{1,6}|[IVXLC]{1,6})[)\].]\s+(\S.*)", re.DOTALL)
AUTHOR_DATE = re.compile(r"([A-Z][\w'’-]+),\s+[A-Z][^.]{0,60}[.,].*?(?<![A-Za-z0-9_])(1[6-9][0-9]{2}|20[0-9]{2})(?![A-Za-z0-9_])", re.DOTALL)
HOST = re.compile(r"notes?|endnotes|commentary|bibliography|works\s+cited|further\s+reading|glossary|abbreviations", re.IGNORECASE)
BRACKETED = re.compile(r"\[\s?([0-9]{1,3}|\*{1,3}|†{1,3}|‡{1,3})\s?\]")
PARENTHESIZED = re.compile(r"(?<=[\p{L}.,;:!?'\"’”])\s?\(([0-9]{1,3})\)(?![\p{L}\p{N}])")
GLUED = re.compile(rf"(?<=[\p{{L}}\p{{N}}.,;:!?'\"’”)\]])({SYMBOLS})(?![\p{{L}}\p{{N}}*†‡§¶])")
ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
SIGNS = {BRACKETED: "[", PARENTHESIZED: "(", GLUED: "*†‡§¶"}
LABELS = {"numeric": "numbered", "symbol": "symbol", "alphabetic": "lettered", "roman": "roman-numeral"}
LONGEST_LEMMA, LEMMA_AHEAD = 220, 90


@lru_cache(4096)
def marker_key(token: str) -> str:
    core = re.sub(r"\s*[\])>}]?[.:]?$", "", re.sub(r"^[\[(<{]\s*", "", token.strip())).strip()
    return core.lower() if re.fullmatch("[A-Za-z]+", core) else core


@lru_cache(4096)
def marker_class(key: str) -> str | None:
    low = key.lower()
    if re.fullmatch("[0-9]{1,3}", key):
        return "numeric"
    if re.fullmatch(SYMBOLS, key):
        return "symbol"
    if low and len(low) <= 6 and ROMAN.fullmatch(low):
        return "roman"
    return "alphabetic" if re.fullmatch("[a-z]", low) else None


def _italic_head(block: dict) -> str | None:
    """The first emphasised run, if little stands before it."""
    before = 0
    for r in block["runs"]:
        if r.get("em"):
            return re.sub(r"[:.,;]$", "", r["t"].strip()) if before < LEMMA_AHEAD else None
        before += len(r["t"])
    return None


def match_entry(block: dict) -> dict | None:
    """key, cls, rest, lemma of a block that opens like a note entry; else None.

    A symbol, a number, a letter or numeral with its closing mark, a raised key, or a number set against italics.
    """
    text, runs = block["text"], block["runs"]
    key = cls = rest = None
    if m := SYMBOL_ENTRY.fullmatch(text):
        key, rest, cls = m[1], m[2], "symbol"
    elif m := KEYED_ENTRY.fullmatch(text):
        key, rest, cls = m[1], m[2], "numeric"
    elif (m := LETTERED_ENTRY.fullmatch(text)) and marker_class(m[1].lower()) in ("roman", "alphabetic"):
        key, rest, cls = m[1].lower(), m[2], marker_class(m[1].lower())
    elif len(runs) > 1 and runs[0].get("sup") and marker_class(marker_key(runs[0]["t"])):
        key = marker_key(runs[0]["t"])
        rest, cls = text[len(runs[0]["t"]) :].lstrip(), marker_class(key)
    elif len(runs) > 1 and runs[1].get("em") and re.fullmatch("[0-9]{1,4}[a-z]?", runs[0]["t"].strip()):
        key = runs[0]["t"].strip()
        rest, cls = text[len(key) :].lstrip(), "numeric"
    if key is None:
        return None
    colon = re.search(r":\s", rest)
    lemma = rest[: colon.start()].strip() if colon and 0 < colon.start() < LONGEST_LEMMA else _italic_head(block)
    lemma = re.sub(r"[:.,;]$", "", " ".join(lemma.split())).strip() if lemma else None
    return {"block": block, "key": key, "cls": cls, "rest": rest, "lemma": lemma or None}


def opening_lemma(block: dict) -> str | None:
    """The catchphrase of an entry without a key: quoted, in italics, or short and closed by a colon or dash."""
    text = block["text"].strip()
    if len(text) < 4:
        return None
    if m := re.match(r"[\"“‘']([^\"”’']{2,140})[\"”’'](?:\s*[:,.—–-]|\s)", text):
        return m[1].strip()
    runs = block["runs"]
    if runs and runs[0].get("em") and 3 <= len(runs[0]["t"].strip()) <= 120:
        tail = runs[1:]
        if "".join(r["t"] for r in tail).strip() and not all(r.get("em") for r in tail):
            return re.sub(r"[:,.;—–-]+$", "", runs[0]["t"].strip())
    m = re.search(r"[:—–]\s", text)
    if m and 2 < m.start() < 140:
        head = text[: m.start()].strip()
        if not re.search("[.!?]", head) and len(head.split()) <= 14:
            return head
    return None


class Tree:
    """Ancestry of a document's sections."""

    def __init__(self, sections: list[dict]):
        self.by_id = {s["section_id"]: s for s in sections}

    def path(self, section_id: str | None) -> list[dict]:
        """The section and all above it, nearest first."""
        out, seen = [], set()
        while section_id in self.by_id and section_id not in seen:
            seen.add(section_id)
            out.append(self.by_id[section_id])
            section_id = out[-1]["parent"]
        return out

    def in_apparatus(self, section_id: str) -> bool:
        return any(s["type"] in ("apparatus", "appendix") for s in self.path(section_id))

    def scope(self, section_id: str) -> dict:
        """The number of the nearest volume, book, part and chapter."""
        out = dict.fromkeys(("volume", "book", "part", "chapter"))
        for s in self.path(section_id):
            if s["type"] in out and out[s["type"]] is None:
                out[s["type"]] = s["number"]
        return out


def kind_of(label: str, grammar: str) -> str:
    low = label.lower()
    for words, kind in ((("bibliograph", "works cited", "further reading"), "bibliography"), (("glossar",), "glossary"), (("textual",), "textual-apparatus"), (("commentar",), "line-commentary")):
        if any(w in low for w in words):
            return kind
    return "line-commentary" if grammar in ("line-keyed", "book-line") else "footnote" if "footnote" in low else "endnote"


def _system(n: int, **values) -> dict:
    return {"system_id": f"sys{n}", "key_scope": "document", "hosts": [], **values}


def _enter(block: dict, system: dict, key: str, lemma: str | None, numeric: int | None) -> dict:
    block.update(type="entry", system=system["system_id"], key=key)
    if lemma:
        block["lemma"] = lemma
    return {"block_id": block["block_id"], "system": system["system_id"], "key": key, "numeric": numeric, "lemma": lemma, "section": block["section"]}


def apparatus(blocks: list[dict], sections: list[dict], has_verse: bool) -> tuple[list[dict], list[dict], list[dict]]:
    """(systems, entries, rejected hosts) of the back matter; blocks that turn out entries are marked as such.

    A host inside another keeps its own blocks. Of a host's entries, marker classes of at least three are systems of
    their own beside the commonest; strays join that.
    """
    tree = Tree(sections)
    hosts = [s for s in sections if s["type"] in ("apparatus", "appendix") and HOST.search(s["label"])]
    systems, entries, rejected = [], [], []
    for host in hosts:
        nested = [h for h in hosts if h is not host and host in tree.path(h["parent"])]
        scoped = [b for b in blocks if host["start"] <= b["ord"] < host["end"] and b["type"] in PROSE and not any(h["start"] <= b["ord"] < h["end"] for h in nested)]
        refuse = lambda why, host=host: rejected.append({"label": host["label"], "reason": why})
        if len(scoped) < 4:
            refuse(f"{len(scoped)} paragraphs")
            continue
        matched = [m for b in scoped if (m := match_entry(b))]
        dated = [(b, m) for b in scoped if (m := AUTHOR_DATE.match(b["text"]))]
        keyed, bib = len(matched) / len(scoped), len(dated) / len(scoped)
        if bib > 0.45 and bib >= keyed:
            systems.append(_system(len(systems), kind="bibliography", label=host["label"], grammar="author-date", hosts=[host["section_id"]], entry_count=len(dated), confidence=min(0.95, 0.6 + bib / 2)))
            entries += [_enter(b, systems[-1], f"{m[1]} {m[2]}", None, None) for b, m in dated]
        elif keyed >= 0.4 and len(matched) >= 4:
            _keyed_systems(host, scoped, matched, keyed, has_verse, tree, systems, entries)
        else:
            phrases = [(b, p) for b in scoped if (p := opening_lemma(b))]
            if len(phrases) >= 4 and len(phrases) / len(scoped) >= 0.5:
                kind = "line-commentary" if "commentar" in host["label"].lower() else "endnote"
                systems.append(_system(len(systems), kind=kind, label=host["label"], grammar="lemma-keyed", key_scope="section", hosts=[host["section_id"]], entry_count=len(phrases), confidence=min(0.9, 0.45 + len(phrases) / len(scoped) * 0.45)))
                entries += [_enter(b, systems[-1], f"endnote-auto-{k:03d}", p, None) for k, (b, p) in enumerate(phrases, 1)]
            else:
                refuse(f"{len(matched)} keys and {len(phrases)} phrases in {len(scoped)} paragraphs")
    return systems, entries, rejected


def _keyed_systems(host, scoped, matched, keyed, has_verse, tree, systems, entries) -> None:
    place = {id(b): k for k, b in enumerate(scoped)}
    by_class: dict[str, list] = defaultdict(list)
    for m in matched:
        by_class[m["cls"]].append(m)
    chief = max(by_class, key=lambda c: len(by_class[c]))
    groups = [c for c in by_class if c == chief or len(by_class[c]) >= 3]
    by_class[chief] += [m for c in by_class if c not in groups for m in by_class[c]]
    for cls in groups:
        group = sorted(by_class[cls], key=lambda m: place[id(m["block"])])
        numbers = [int(n[0]) for m in group if (n := re.match("[0-9]+", m["key"]))]
        resets = sum(b <= a for a, b in zip(numbers, numbers[1:], strict=False))
        italic = sum(_italic_head(m["block"]) is not None for m in group) / len(group)
        by_line = has_verse and max(numbers, default=0) > 60 and italic > 0.4
        framed = sum(m["block"]["text"].lstrip().startswith("[") for m in group) > len(group) / 2
        grammar = cls if cls != "numeric" else "line-keyed" if by_line else "bracketed" if framed else "sequential"
        types = {s["type"] for m in group for s in tree.path(m["block"]["section"])[:1]}
        scope = "document" if not resets else "book" if by_line else next((t for t in ("chapter", "book") if t in types), "section")
        label = f"{host['label']} ({LABELS[cls]})" if len(groups) > 1 else host["label"]
        systems.append(_system(len(systems), kind=kind_of(host["label"], grammar), label=label, grammar=grammar, key_scope=scope, hosts=[host["section_id"]], entry_count=len(group), confidence=min(0.97, 0.5 + keyed * 0.4 + (0.1 if italic > 0.4 else 0))))
        for m in group:
            n = re.match("[0-9]+", m["key"]) if cls == "numeric" else None
            entries.append(_enter(m["block"], systems[-1], m["key"], _italic_head(m["block"]), int(n[0]) if n else None))


def sought(form, text: str):
    """Matches of a marker's form, sought where a sign that it cannot do without stands in the text."""
    return form.finditer(text) if any(c in text for c in SIGNS[form]) else ()


def inline_keys(block: dict) -> list[str]:
    keys = [marker_key(r["t"]) for r in block["runs"] if r.get("sup")]
    keys += [marker_key(m[1]) for m in sought(BRACKETED, block["text"])] + [m[1] for m in sought(GLUED, block["text"])]
    return [k for k in keys if marker_class(k)]


def page_notes(blocks: list[dict], sections: list[dict], first: int) -> tuple[list[dict], list[dict]]:
    """(systems, entries) of notes at the foot of pages: keyed paragraphs whose key is printed before, here or a page back."""
    tree = Tree(sections)
    callers: dict[tuple[int, str], int] = {}
    for b in blocks:
        if (b["type"] in PROSE or b["type"] == "verse-line") and not tree.in_apparatus(b["section"]):
            for k in inline_keys(b):
                callers.setdefault((b["page"], k), b["ord"])
    found: dict[str, list] = defaultdict(list)
    for b in blocks:
        if b["type"] in PROSE - {"list-item"} and not tree.in_apparatus(b["section"]) and (m := match_entry(b)):
            key = marker_key(m["key"])
            cls = marker_class(key)
            if cls and any(callers.get((b["page"] - d, key), b["ord"]) < b["ord"] for d in (0, 1)):
                found[cls].append((b, key))
    systems, entries = [], []
    for cls, pairs in found.items():
        if cls == "symbol" or len(pairs) >= 2:
            grammar = "sequential" if cls == "numeric" else cls
            systems.append(_system(first + len(systems), kind="footnote", label=f"Footnotes ({LABELS[cls]})", grammar=grammar, key_scope="section", entry_count=len(pairs), confidence=min(0.95, 0.6 + len(pairs) * 0.05)))
            entries += [_enter(b, systems[-1], k, None, None) for b, k in pairs]
    return systems, entries


def longest_count(numbers: list[int]) -> int:
    """The longest stretch that counts up by one, a return to 1 starting anew."""
    best = run = last = 0
    for n in numbers:
        if n == 1:
            run = 1
        elif n == last + 1:
            run += 1
        elif n != last:
            run = 0
        last = n
        best = max(best, run)
    return best


def census(blocks: list[dict], tree: Tree) -> dict:
    """How the running text sets its markers: counts by setting and class, the tokens, and the settings that count."""
    usage: dict[str, Counter] = {s: Counter() for s in ("superscript", "bracketed", "parenthesized", "glued")}
    tokens, numbers = [], []
    for b in blocks:
        if b["type"] in ("heading", "entry") or tree.in_apparatus(b["section"]):
            continue
        seen = [("superscript", marker_key(r["t"])) for r in b["runs"] if r.get("sup")]
        seen += [("bracketed", marker_key(m[1])) for m in sought(BRACKETED, b["text"])]
        parens = [m[1] for m in sought(PARENTHESIZED, b["text"])]
        numbers += map(int, parens)
        seen += [("parenthesized", p) for p in parens] + [("glued", m[1]) for m in sought(GLUED, b["text"])]
        for setting, key in seen:
            if cls := marker_class(key):
                usage[setting][cls] += 1
                tokens.append((setting, key))
    confirmed = ["superscript", "bracketed", "glued"] + ["parenthesized"] * (longest_count(numbers) >= 3)
    return {"usage": usage, "tokens": tokens, "confirmed": confirmed}


def profiles(systems: list[dict], entries: list[dict], blocks: list[dict], tokens: list[tuple[str, str]]) -> list[dict]:
    """Each system's classes, vocabulary (60 at most), resets, pages, where its keys are set, and with whom it shares keys."""
    page = {b["block_id"]: b["page"] for b in blocks}
    own: dict[str, list] = defaultdict(list)
    for e in entries:
        own[e["system"]].append(e)
    keys = {s: [marker_key(e["key"]) for e in es] for s, es in own.items()}
    out = []
    for s in systems:
        es, ks = own.get(s["system_id"], []), keys.get(s["system_id"], [])
        if not es:
            continue
        numbers = [int(k) for k in ks if k.isdigit()]
        pages = [p for e in es if (p := page.get(e["block_id"], 0)) > 0]
        out.append({
            "system_id": s["system_id"], "classes": sorted({c for k in ks if (c := marker_class(k))}), "vocabulary": list(dict.fromkeys(ks))[:60], "entry_count": len(es),
            "resets": sum(b < a for a, b in zip(numbers, numbers[1:], strict=False)), "pages": [min(pages), max(pages)] if pages else None,
            "settings": dict(Counter(t for t, k in tokens if k in set(ks))), "shares_keys_with": sorted(o for o, other in keys.items() if o != s["system_id"] and set(other) & set(ks)),
        })
    return out

"""Books made of positioned spans for tests: chapters, notes, verse, running heads, page numbers."""

import random

SPANS = "doc_id string, page int, o int, x double, y double, w double, s double, f string, t string, em boolean, strong boolean, sc boolean"
WORDS = "river stone window garden letter morning silver branch winter harbour candle meadow thunder journey velvet copper lantern orchard willow marble".split()


class Book:
    def __init__(self, doc_id="b", seed=1):
        self.doc_id, self.rows, self.page, self.y, self.r, self.o = doc_id, [], 0, 0.0, random.Random(seed), 0

    def new_page(self):
        self.page += 1
        self.y = 720.0
        self.o = 0
        return self

    def put(self, text, x=72.0, size=12.0, width=None, dy=0.0, font="roman", em=False, sup=False, same=False):
        if not same:
            self.y -= dy or 14.0
        y = self.y + (4.0 if sup else 0.0)
        w = width if width is not None else len(text) * size * 0.5
        self.rows.append((self.doc_id, self.page, self.o, x, y, w, size, font, text, em, False, False))
        self.o += 1
        return x + w

    def line(self, text, **k):
        return self.put(text, width=k.pop("width", 456.0), **k)

    def sentence(self, n=11):
        s = " ".join(self.r.choice(WORDS) for _ in range(n))
        return s[0].upper() + s[1:] + "."

    def prose(self, lines=5, indent=True):
        """A paragraph: first line indented, the last one short."""
        for k in range(lines):
            first, last = k == 0 and indent, k == lines - 1
            text = self.sentence() if k == 0 else self.sentence().lower()
            self.put(text, x=90.0 if first else 72.0, width=(438.0 if first else 456.0) if not last else 200.0)
        return self

    def heading(self, text, size=18.0):
        self.put(text, size=size, x=200.0, width=150.0, dy=40.0)
        self.y -= 26.0
        return self


def noted_book(doc_id="noted"):
    """Two chapters of 3 pages with raised and bracketed markers, and a list of notes for them at the end."""
    b = Book(doc_id)
    n = 0
    for chapter in (1, 2):
        for page in range(3):
            b.new_page()
            if page == 0:
                b.heading(f"Chapter {chapter}")
            for _ in range(4):
                b.prose(5)
            n += 1
            end = b.put(f"The {WORDS[n]} garden was {WORDS[n + 7]}", x=90.0, width=180.0)
            if chapter == 1:
                b.put(f"[{n}]", x=end, size=7.0, width=12.0, sup=True, same=True)
            else:
                b.put(f"[{n}] and then they left.", x=end + 1, width=150.0, same=True)
            if page == 1:
                b.put("See Chapter 2 for more of it.", x=90.0, width=200.0, dy=24.0)
    b.new_page().heading("Notes")
    for k in range(1, n + 1):
        b.put(f"{k}. This note explains the {WORDS[k]} and the {WORDS[k + 1]} in full.", x=72.0, width=300.0, dy=22.0)
    return b


def numbered_book(doc_id="numbered", pages=30):
    """Prose with the page's number less 2 at each foot and the chapter's name at each head."""
    b = Book(doc_id, 2)
    for p in range(1, pages + 1):
        b.new_page()
        b.put(f"The {['first', 'second', 'third'][(p - 1) // 10]} part of it", x=200.0, width=120.0)
        b.y -= 20
        for _ in range(4):
            b.prose(5)
        if p > 2:
            number = str(p - 2) if p not in (15, 20) else (f"{p - 2} x" if p == 15 else "13")
            b.y = 40.0
            b.put(number, x=300.0, width=12.0)
    return b


def verse_book(doc_id="verse"):
    """Prose, then 60 lines of verse with every fifth numbered in the margin, in a book that the prose names."""
    b = Book(doc_id, 3)
    b.new_page().heading("Book 1")
    for _ in range(4):
        b.prose(5)
    n = 0
    for _ in range(2):
        b.new_page()
        if n == 0:
            b.heading("Book 2")
        for _ in range(30):
            n += 1
            text = " ".join(b.r.choice(WORDS) for _ in range(6)).capitalize() + ("," if n % 3 else ".")
            if n % 5 == 0:
                b.put(str(n), x=72.0, width=12.0)
                b.put(text, x=120.0, width=220.0, same=True)
            else:
                b.put(text, x=120.0, width=220.0)
    b.new_page().heading("Book 3")
    for _ in range(3):
        b.prose(5)
    b.put("Compare Book 2, line 35 of the poem, and see below.", x=90.0, width=300.0, dy=24.0)
    return b


def frame(spark, *books):
    return spark.createDataFrame([row for b in books for row in b.rows], SPANS)

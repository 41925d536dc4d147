"""Registered queries that SQL can't express, on the smallest tables against plain versions."""

import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from test_rendering import item

from leafmill.plans import layout_queries, registry
from leafmill.plans.document_queries import running
from leafmill.plans.tables import blocks, read
from leafmill.sources.html import page_items

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def boxes(spark):
    out = defaultdict(list)
    for r in layout_queries.boxes(spark, SF).collect():
        out[r.book, r.page].append((r.seq, r.x0, r.y0, r.x1, r.y1))
    return {k: sorted(v) for k, v in out.items()}


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def crosses(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def share(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) if w > 0 and h > 0 else 0.0


def test_rect_clusters(spark, boxes):
    want = set()
    for (book, page), found in boxes.items():
        parts = []
        for _, *b in found:
            near = [p for p in parts if any(max(b[0], q[0]) - min(b[2], q[2]) <= 10 and max(b[1], q[1]) - min(b[3], q[3]) <= 10 for q in p)]
            parts = [p for p in parts if p not in near] + [[b, *(q for p in near for q in p)]]
        taken = [b for seq, *b in found if seq == 1] if page % 4 == 0 else []
        for p in parts:
            box = (min(b[0] for b in p), min(b[1] for b in p), max(b[2] for b in p), max(b[3] for b in p))
            if box[2] - box[0] >= 30 and box[3] - box[1] >= 30 and not any(crosses(box, t) for t in taken):
                want.add((book, page, len(p), *box))
    assert {(r.book, r.page, r.n, r.x0, r.y0, r.x1, r.y1) for r in rows(spark, "rect_clusters")} == want


def test_distinct_spans(spark, boxes):
    want = set()
    for key, found in boxes.items():
        kept = defaultdict(list)
        for seq, *b in found:
            text = "" if seq % 5 == 0 else f"w{seq % 2}"
            same = kept[seq // 4]
            if not text or not any(t == text and (share(b, q) >= 0.7 or all(abs(x - y) <= 2 for x, y in zip(b, q, strict=True))) for t, q in same):
                same.append((text, b))
                want.add((*key, seq // 4, seq))
    assert {(r.book, r.page, r.line, r.seq) for r in rows(spark, "distinct_spans")} == want


def test_inserted_figures(spark, boxes):
    want = set()
    for key, found in boxes.items():
        order = [("text", seq, b[1]) for seq, *b in found if seq % 3 == 1]
        for kind, rest in (("image", 0), ("table", 2)):
            for seq, *b in (x for x in found if x[0] % 3 == rest):
                order.insert(next((i for i, x in enumerate(order) if x[2] > b[1]), len(order)), (kind, seq, b[1]))
        want |= {(*key, i, kind, seq) for i, (kind, seq, _) in enumerate(order)}
    assert {(r.book, r.page, r.place, r.kind, r.seq) for r in rows(spark, "inserted_figures")} == want


def test_caption_greedy(spark):
    pages = defaultdict(list)
    for r in blocks(spark, SF).collect():
        pages[r.book, r.page].append(r)
    want = set()
    for key, found in pages.items():
        found = sorted(found, key=lambda r: r.seq)
        free = {r.seq: r for r in found if r.seq % 3 == 1 or (r.seq % 3 == 2 and re.match(r"(?i)(figure|fig\.?|diagram|illustration|plate)", r.text.strip()) and len(r.text.split()) <= 40)}
        for a in (r for r in found if r.seq % 3 == 0):
            near = [(b.y0 - a.y1 if b.y0 >= a.y1 else a.y0 - b.y1, b.seq) for b in free.values() if b.y0 >= a.y1 or a.y0 >= b.y1]
            near = [x for x in near if x[0] <= 30]
            if near:
                want.add((*key, a.seq, min(near)[1]))
                del free[min(near)[1]]
    assert {(r.book, r.page, r.image, r.caption) for r in rows(spark, "caption_greedy")} == want


def test_fuzzy_headers(spark):
    bands = defaultdict(list)
    for r in running(spark, SF).collect():
        band = "header" if r.y1 <= 90 else "footer" if r.y0 >= 510 else "margin" if r.x1 <= 60 or r.x0 >= 440 else None
        norm = " ".join(re.sub(r"\d", "#", r.text).lower().split())
        if band and norm:
            bands[r.book, band].append((r.page, r.seq, norm))
    want = set()
    for key, found in bands.items():
        clusters = []
        for _, _, norm in sorted(found):
            best = max(clusters, key=lambda c: SequenceMatcher(None, norm, c[0]).ratio(), default=None)
            if best and SequenceMatcher(None, norm, best[0]).ratio() >= 0.82:
                best.append(norm)
            else:
                clusters.append([norm])
        want |= {(*key, c[0], len(c), tuple(sorted(set(c)))) for c in clusters if len(c) >= 5}
    got = {(r.book, r.band, r["first"], r.n_lines, tuple(r.members)) for r in rows(spark, "fuzzy_headers")}
    assert got == want and len(got) > 10


def test_html(spark):
    pages = {r.page_id: page_items(r.html or "") for r in read(spark, SF, "pages").collect()}
    want = {(k, x["section"], x["item"], x["section_title"], x.get("kind"), x.get("text")) for k, xs in pages.items() for x in xs}
    assert {(r.page_id, r.section, r.item, r.section_title, r.kind, r.text) for r in rows(spark, "html_flow")} == want
    told = {}
    for key, xs in pages.items():
        lines = []
        for x in xs:
            full = {"text": None, "lines": None, "label": None, "attribution": None, "numbering": None, "italic": None, "display": None, "quoted": None, "complex": False, "caption": None} | x
            if x["item"] == 0 and x["section_title"] is not None:
                lines += ["#" * x["section_level"] + " " + x["section_title"], ""]
            if x.get("kind") == "callout":
                lines += [f"> [!{ {'Warning': 'warning', 'Tip': 'tip', 'Caution': 'warning', 'Important': 'important', 'Note': 'note'}.get(x['label'], 'info')}] {x['label']}", *(f"> {y}" for y in x["lines"] if y), ""]
            elif x.get("kind"):
                lines += [*item(full, None, None, None), ""]
        if xs:
            told[key] = "\n".join(lines).rstrip(" \t\n\x0b\f\r")
    assert {r.page_id: r.markdown for r in rows(spark, "html_markdown")} == told

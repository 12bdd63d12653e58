"""What the operators should give, written as plainly as possible, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(docs, window=13):
    """{(row)}: (doc_id, n_words, n_removed, kept_sha256) of each document."""
    words = [VISIBLE.findall(t or "") for _, t in docs]
    first = {}
    for (doc, _), ws in zip(docs, words, strict=True):
        for i in range(len(ws) - window + 1) if doc is not None else ():
            key = tuple(ws[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), ws in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1) if doc is not None else ():
            if first[tuple(ws[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, item ids) of each document."""
    windows = defaultdict(set)
    for item, text in items:
        ws = ALNUM.findall(lowered(text))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n and item is not None else ():
            windows[tuple(ws[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = ALNUM.findall(lowered(text)), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (key := tuple(ws[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(ws), len(hit), sorted(found)))
    return out


def shingle_counts(text, n=5):
    ws = ALNUM.findall(lowered(text))
    counts = defaultdict(int)
    for i in range(max(1, len(ws) - n + 1) if ws else 0):
        counts[tuple(ws[i : i + n])] += 1
    return counts


def similarity(x, y):
    """Probability Jaccard, by its definition."""
    total = 0.0
    every = set(x) | set(y)
    for i in set(x) & set(y):
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every)
    return total


def near_classes(docs, threshold=0.8):
    """{doc_id: least id of its class}, by all pairs."""
    sets = [shingle_counts(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = defaultdict(set)
    for i, s in enumerate(sets):
        for key in s:
            by_shingle[key].add(i)
    pairs = {(i, j) for members in by_shingle.values() for i in members for j in members if i < j}
    texts = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        texts[t or ""].append(i)
    for group in texts.values():
        for i in group[1:]:
            parent[root(i)] = root(group[0])
    for i, j in sorted(pairs):
        if root(i) != root(j) and min(len(sets[i]), len(sets[j])) * 2 > max(len(sets[i]), len(sets[j])) and similarity(sets[i], sets[j]) >= threshold:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(docs)}


def conversations(rows, trained="assistant"):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text) rows."""
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, role, text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort(key=lambda t: t[0])
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == trained)
        out[conv] = len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


def captures(pages):
    """{page_id: (payload_bytes, digest, record_type, refers_to)} of (page_id, html) rows."""
    best = {}
    for page, html in pages:
        best[html or ""] = max(best.get(html or "", page), page)
    out = {}
    for page, html in pages:
        raw, keep = (html or "").encode(), best[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page] = len(raw), digest, "response" if page == keep else "revisit", None if page == keep else keep
    return out


def ranking(docs, items, top=20):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) rows for (item_id, text) rows."""
    import math
    from collections import Counter

    counts = [Counter(ALNUM.findall(lowered(t))) for _, t in docs]
    n_docs, n_words = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += ALNUM.findall(lowered(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            score = 0
            for t in terms:
                if c[t]:
                    m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


def variants(docs, drop_every=None, least_length=6, least_count=5, ratio=5):
    """[(word, form, root, n, n_near, form_n)], by all pairs of words."""
    import zlib
    from collections import Counter

    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    met = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(met[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(met[w]), words.get(form[w])))
    return out


def byte_repeats(docs, window=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]; rows of one id are documents in the order given."""
    rows = [(doc, (text or "").encode()) for doc, text in docs]
    order = sorted((r for r in range(len(rows)) if rows[r][0] is not None), key=lambda r: (rows[r][0], r))
    seen, gone = set(), {r: set() for r in range(len(rows))}
    for r in order:
        raw = rows[r][1]
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[r].update(range(i, i + window))
            seen.add(raw[i : i + window])
    out = []
    for r, (doc, raw) in enumerate(rows):
        kept = bytes(b for i, b in enumerate(raw) if i not in gone[r])
        runs = sum(1 for i in gone[r] if i - 1 not in gone[r])
        out.append((doc, len(raw), len(gone[r]), runs, hashlib.sha256(kept).hexdigest()))
    return out

"""Plain versions of what the operators compute, for small tables."""

import re
from collections import Counter, defaultdict

from tradewind.llm.common import words_of


def strip_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def kept_lines(texts, min_docs):
    counts = Counter(k for t in texts for k in {strip_key(line) for line in (t or "").split("\n")} if k)
    lost = {k for k, n in counts.items() if n >= min_docs}
    return [[line for line in (t or "").split("\n") if strip_key(line) not in lost] for t in texts]


def hits(texts, items, window):
    """Per text: hit word positions and ids of the items found."""
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows[tuple(words[i:i + size])].add(item)
    out = []
    for text in texts:
        words, places, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i:i + size]))
                if owners:
                    places |= set(range(i, i + size))
                    found |= owners
        out.append((places, found))
    return out


def shingle_set(text, size=5):
    words = words_of(text)
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def near_classes(rows, threshold=0.8):
    """Per row (id, text): smallest id of its class, size of the class, number of links."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i in range(len(rows)):
        group = members[find(i)]
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out.append((min(ids) if ids else None, len(group), links[i]))
    return out


def repeated_windows(texts, window):
    """Per text: (bytes, removed bytes, spans, what is left)."""
    raws, counts, out = [(t or "").encode() for t in texts], Counter(), []
    for raw in raws:
        counts.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    for raw in raws:
        spans = []
        for i in range(len(raw) - window + 1):
            if counts[raw[i:i + window]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        left, at = b"", 0
        for begin, end in spans:
            left, at = left + raw[at:begin], end
        left += raw[at:]
        out.append((len(raw), len(raw) - len(left), len(spans), left))
    return out


def personal_data(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def secrets(text):
    text, out = text or "", []
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))

"""Plain Python forms of the operators, for comparison."""

import re

UPPER = {c: c + 32 for c in range(65, 91)}


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    words = blank_words((text or "").translate(UPPER))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def near_components(texts, size, percent):
    """Smallest reachable id of each id."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def without_repeats(texts, window):
    """Kept words of each id."""
    first = {}
    for i in sorted(texts):
        words = blank_words(texts[i])
        for p in range(len(words) - window + 1):
            first.setdefault(tuple(words[p : p + window]), i)
    out = {}
    for i, text in texts.items():
        words = blank_words(text)
        gone = {p + k for p in range(len(words) - window + 1) if first[tuple(words[p : p + window])] < i for k in range(window)}
        out[i] = [w for p, w in enumerate(words) if p not in gone]
    return out


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contaminated(texts, items, window):
    """(words, hit words, ids) of each id."""
    out = {}
    for i, text in texts.items():
        words, hit, ids = index_words(text), set(), set()
        for item, body in items:
            found = index_words(body)
            n = min(window, len(found))
            grams = {tuple(found[p : p + n]) for p in range(len(found) - n + 1)} if n else set()
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
        out[i] = (len(words), len(hit), sorted(ids))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
    }
    found = []
    for rank, (kind, (pattern, ok)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            if ok(m[0], re.sub("[^0-9]", "", m[0])):
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def repeat_words(text, size=8):
    words = blank_words(text)
    grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(size)})

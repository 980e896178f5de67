"""Small books and a direct evaluation of the rules, row by row, to hold the dataflows against."""

import random
import re
import unicodedata

FRENCH = {"espagnole", "veloute", "bechamel", "hollandaise", "roux", "glace-de-viande"}


def fold(x):
    plain = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")


def runs(name, wanted):
    return f"-{wanted}-" in f"-{name}-"


def says(title):
    kind, served = re.search(r"\bSAUCE\b", title, re.I), re.search(r"\bWITH\b", title, re.I)
    return bool(kind) and not re.search(r",\s*SAUCE\b", title, re.I) and (not served or kind.start() < served.start())


def evaluate(lines):
    """[(entry, idx, title, concept, parent)] and the declared bases."""
    text = "\n".join(lines)
    m = re.search(r"basic sauces?:\s*(.+?)\.", text, re.I | re.S)
    bases = sorted({fold(x) for x in re.split(r",|\band\b", m[1]) if x.strip()}) if m else []
    kept_chapter, entries = False, []
    for i, line in enumerate(lines):
        if re.match(r"CHAPTER\s+[IVXL]+$", line.strip()):
            ahead = [x.strip().strip("=") for x in lines[i + 1 : i + 6]]
            kept_chapter = bool(re.search(r"\bSAUCES?\b", next((x for x in ahead if x), ""), re.I))
        if h := re.match(r"(\d{1,4})—(.+)$", line):
            entries.append([int(h[1]), i, h[2].strip(), [], kept_chapter])
        elif entries:
            entries[-1][3].append(line)
    rows = []
    for n, i, title, body, inside in entries:
        if says(title) or (inside and set(bases) & set(fold(title).split("-"))):
            terms = [fold(t) for t in (x.strip(" .,—") for x in re.split(r"\s+OR\s+", title, flags=re.I)) if t]
            rows.append({"n": n, "i": i, "title": title, "terms": terms, "concept": terms[0] if terms else fold(title), "body": "\n".join(body).strip()})
    index, place = {}, {r["n"]: k for k, r in enumerate(rows)}
    for r in rows:
        for name in r["terms"] or [r["concept"]]:
            index.setdefault(name, r)
    names = {name: (r["n"], r["concept"], False) for name, r in index.items()}
    for b in bases:
        hits = [index[b]] if b in index else sorted((r for name, r in index.items() if runs(name, b)), key=lambda r: place[r["n"]])
        names[b] = (hits[0]["n"] if hits else b, b, True)
    parent = {}
    for r in rows:
        own = {*r["terms"], fold(r["title"])}
        spans = []
        sentences = [fold(s).split("-") for s in re.split("[.!?;:]", r["body"].split("\n\n")[0]) if re.search("[a-zA-Z0-9]", s)]
        for name, (key, _, base) in names.items():
            if key == r["n"] or key in own or (not base and any(runs(o, name) for o in own)):
                continue
            w = name.split("-")
            spans += [(s, k, k + len(w), name) for s, words in enumerate(sentences) for k in range(len(words)) if words[k : k + len(w)] == w]
        free = {x[3] for x in spans if not any(c[0] == x[0] and c[1] <= x[1] and x[2] <= c[2] and c[2] - c[1] > x[2] - x[1] and names[c[3]][0] != names[x[3]][0] for c in spans)}
        keys = {names[x][0] for x in free}
        said = sorted(names[x][1] for x in free if names[x][2])
        parent[r["n"]] = None if len(keys) != 1 else said[0] if said else next(names[x][1] for x in names if x in free)
    step = {records: key for key, records, _ in names.values() if isinstance(key, int)}
    on_cycle = set()
    for n in parent:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = step.get(parent.get(at))
        if at is not None:
            on_cycle |= set(seen[seen.index(at) :])
    return [(r["n"], r["i"], r["title"], r["concept"], None if r["n"] in on_cycle else parent[r["n"]]) for r in rows], bases


def random_book(seed, n=60):
    """Titles and openings over a small vocabulary, so that everything collides."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Onion", "Caper", "Brown", "Velouté", "Marrow", "Herb", "Wine", "tomato", "Roux", "Cream", "Lenten"])
    name = lambda: " ".join(word() for _ in range(rng.randint(1, 2)))
    lines = ["preface", f"The basic sauces: {word()}, {word()} {word()},", f"and {word()}. More."]
    for k in range(1, n):
        if rng.random() < 0.15:
            lines += [f" CHAPTER {rng.choice(['IV', 'XL', 'I'])} ", rng.choice(["", "=  =", "=COLD SAUCES="]), rng.choice(["SAUCE", "FISH", ""])]
        title = name() + rng.choice(["", " SAUCE", f" or {name()} Sauce", " SAUCE WITH RICE", " WITH SAUCE", f", SAUCE {word()}", f" OR {name()}, OR SAUCE {word()}."])
        number = k if rng.random() < 0.95 else max(1, k - 3)
        said = rng.choice(["Take {}. Boil.", "Mix {} and {}; serve", "To {} add {}!", "Plain."]).format(name(), name())
        lines += [f"{number}—{title}", said, rng.choice(["", "  ", "more text"]), f"Late {name()}.", ""]
    return lines

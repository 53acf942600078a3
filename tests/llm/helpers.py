"""Documents that hold what operators must bear: nulls, empty and very long texts, repeated rows, columns of any name."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(seed: int = 5, n: int = 60, words: int = 400) -> list[tuple]:
    """Random prose over a small vocabulary with copies, near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    line = "A line that many documents share.  "
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        if i % 4 == 1 and rows:  # near copies
            text = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if i % 5 == 2:
            text.insert(rng.randrange(len(text) + 1), passage)
        body = " ".join(text)
        if i % 3 == 0:
            body = f"{line.upper() if i % 2 else line}\n{body}\n{body[:40]}"
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
    rows.append((n, rows[0][1], "en", "copy", 0))
    rows.append((n + 1, None, None, None, None))
    rows.append((n + 2, "", "en", "x", 0))
    rows.append((n + 3, " \t\n \x0b\x0c\r ", "en", "x", 0))
    rows.append((n + 4, "one", "en", "x", 3))
    rows.append((n + 5, "one two", "en", "x", 7))
    rows.append((n + 6, "\x00 odd \U0001f64f\x1c \xa0 text  \n\n\nend \n", "en", "x", 0))
    rows.append((n + 7, "w" * 50_000, "en", "x", 0))
    rows.append((n + 8, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "long", 0))
    rows.append((n + 9, "same same " * 80, "en", "x", 0))
    rows.append((-3, "negative ids are ids", "en", "x", 0))
    return rows


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def words_of(text):
    return (text or "").encode().split()


def near_by_force(texts, size, part, whole):
    """texts: (id, text); component of each id over links of Jaccard >= part / whole."""
    sets = {}
    for i, t in texts:
        w = [x.lower() for x in words_of(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and whole * both >= part * union:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def slow_tiles(a, b, least):
    """Greedy string tiling by its definition."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    least = max(1, min(least, len(a)))
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))

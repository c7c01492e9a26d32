import pyarrow as pa

from paneflow.llm import line_dedup


def spans(text):
    row, line, size, a, b, _ = line_dedup.chunks(pa.array([text or ""], pa.large_string()))
    data = (text or "").encode()
    return [(int(x), int(n), data[i:j]) for x, n, i, j in zip(line, size, a, b, strict=True)]


def brute(rows):
    first, out = {}, []
    for k, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        for x, _, piece in spans(t):
            first.setdefault(piece, (k, t, x))
    for k, t in rows:
        lines = (t or "").split("\n")
        gone = [(x, n) for x, n, piece in spans(t) if first[piece] != (k, t, x)]
        n_lines = len(lines) if t is not None else 0
        for x, n in reversed(gone):
            del lines[x : x + n]
        out.append((k, "\n".join(lines) if t is not None else None, n_lines, sum(n for _, n in gone), ",".join(f"{x}-{x + n - 1}" for x, n in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 3, "clash") for r in rows], "doc_id long, text string, lines int, h string")
    got = line_dedup.dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    return got


def test_chunks_are_whole_lines():
    texts = [None, "", "\n\n", "one line", "a\nb\nc\n" * 50, "é " * 30 + "\nshort\n" + "w " * 25, "x" * 100_000]
    for t in texts:
        lines = (t or "").split("\n")
        for x, n, piece in spans(t):
            assert "\n".join(lines[x : x + n]).encode() == piece
            assert n >= 2 or len(piece.split()) >= line_dedup.LONG
    row, *_ = line_dedup.chunks(pa.array([t or "" for t in texts], pa.large_string()))
    assert len(row) == sum(len(spans(t)) for t in texts)


def test_boundaries_resist_shifts():
    lines = [f"line {i} {i * 7919 % 101}" for i in range(400)]
    a = {p for _, _, p in spans("\n".join(lines))}
    b = {p for _, _, p in spans("\n".join(["new"] * 3 + lines))}
    assert len(a - b) <= 2


def test_repeated_passages(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    block = "\n".join(f"shared {i}" for i in range(40))
    rows = [(1, f"head\n{passage}\ntail"), (2, f"other\n{passage}\nend\n{block}"), (3, f"x\n{block}\ny"), (4, passage), (None, None), (5, ""), (6, None), (7, f"{passage}\n{passage}"), (8, "own line\nanother"), (8, "own line\nanother"), (9, passage + " "), (10, ("z\n" * 30_000)), (11, ("z\n" * 30_000))]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[2].text.split("\n")[:2] == ["other", "end"] and got[4].text == "" and got[1].removed_lines == 0
    assert got[3].removed_lines >= 30 and got[9].removed_lines == 0
    assert check(spark, []) == []


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def covered(rows, least):
    """The lines of all later places of runs of at least ``least`` words, by brute force."""
    seen, out = set(), {}
    for k, t in sorted(rows):
        lines = t.split("\n")
        gone = out.setdefault(k, set())
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j].split())
                if words >= least:
                    if "\n".join(lines[i : j + 1]) in seen:
                        gone.update(range(i, j + 1))
                    else:
                        break
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                seen.add("\n".join(lines[i : j + 1]))
    return out


def test_passages_over_short_lines(spark):
    rows, want = [], {}
    for k, (n, words) in enumerate([(3, 18), (4, 14), (5, 12), (6, 10), (7, 8), (8, 7), (10, 5), (10, 6), (3, 20)]):
        for copy in range(2):
            own = [f"own {k} {copy} {i} and {i * 7}" for i in range(5)]
            lines = [" ".join(f"p{k}w{i}x{j}" for j in range(words)) for i in range(n)]
            rows.append((10 * k + copy, "\n".join(own[: 2 + copy] + lines + own[3:])))
        want[10 * k + 1] = set(range(3, 3 + n))
    assert {k: v for k, v in covered(rows, line_dedup.PASSAGE).items() if v} == {k: v for k, v in want.items()}
    rows += [(500, "z\n" * 300 + "end"), (501, "start\n" + "z\n" * 120 + "stop"), (502, "no passage"), (503, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs, passage=line_dedup.PASSAGE).collect()}
    for k, text in rows[:18]:
        lines = text.split("\n")
        assert got[k].text == "\n".join(x for i, x in enumerate(lines) if i not in want.get(k, set()))
        assert got[k].removed_lines == len(want.get(k, ()))
    assert got[500].text.split("\n").count("z") == line_dedup.PASSAGE and got[501].text == "start\nstop"
    assert got[502].text == "no passage" and got[503].text is None

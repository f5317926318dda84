import random

import pytest

from mediaops.llm import pieces
from mediaops.llm.pieces import MODEL, Lattice, Vocabulary, decode, encode, n_best, segmentations

DOCS = "doc_id long, text string, token_ids string, scores int"


@pytest.fixture(scope="module")
def model():
    return Vocabulary.read(MODEL)


def look(v, piece):
    node, found = v.trie, None
    for c in reversed(piece):
        if c not in node:
            return None
        node, found = node[c]
    return found


def all_segmentations(text, v):
    if not text:
        yield 0, ()
    for j in range(1, len(text) + 1):
        found = look(v, text[:j])
        step = found if found else (v.fallback, v.fall_back(text[:1])) if j == 1 else None
        if step:
            for s, ids in all_segmentations(text[j:], v):
                yield s + step[0], step[1] + ids


def test_n_best_against_all_segmentations(model):
    rng = random.Random(10)
    for text in [" the", " houses", "\n", " ▁x", "aaaaaaaa", " 漢éz", "   a", " theon.", *("".join(rng.choices(" the rinaon", k=9)) for _ in range(20))]:
        want = sorted(all_segmentations(text, model), key=lambda x: -x[0])
        got = n_best(text, model, 5)
        assert [s for s, _ in got] == [s for s, _ in want[:5]]
        assert len({i for _, i in got}) == len(got) and set(got) <= set(want)
        top, ids, cost = Lattice(model).best_path(text)
        assert (top, tuple(ids)) == got[0] and (cost == got[0][0] - got[1][0] if len(got) > 1 else cost == 1 << 62)


def test_paths_of_many_strings_at_once(model):
    rng = random.Random(23)
    plain = Vocabulary(["", " a", "a", "b", "ab", " ", "bab"], [0.0, -2.0, -1.0, -1.0, -2.0, -1.0, -3.0], {}, 0)  # ties, no byte pieces
    for v in (model, plain):
        lattice = Lattice(v)
        for size in (1, 70, 900):
            texts = ["".join(rng.choices(" theraonbb漢é\U0001f600▁\0\t", k=rng.randint(1, 40))) for _ in range(size)]
            best, ids, ends, costs = pieces.best_paths(v, texts)
            bounds = [0, *ends.tolist()]
            got = [(top, ids[a:b].tolist(), cost) for top, a, b, cost in zip(best.tolist(), bounds, bounds[1:], costs.tolist(), strict=False)]
            assert got == [lattice.best_path(x) for x in texts]


def test_new_chunks_are_segmented_at_once(model, monkeypatch):
    """Not one lattice each: op7_sentencepiece took 906 CPU seconds a GB that way, of 900."""
    rng = random.Random(24)
    texts = sorted({"".join(rng.choices(" theraon漢", k=rng.randint(1, 12))) for _ in range(3000)} | {"".join(rng.choices("abc", k=k)) for k in (100, 300, 900)})
    alone = []
    path = Lattice.best_path
    monkeypatch.setattr(Lattice, "best_path", lambda self, text: alone.append(text) or path(self, text))
    known = pieces._Chunks(model, 3)
    known.learn([texts[:2000], texts[1000:]])
    assert len(alone) < pieces._FEW and len(texts) == len(known)
    taken = pieces._Chunks(model, 3, known)
    alone.clear()
    taken.learn([texts[::2]])
    assert not alone and len(taken) == len(texts[::2])
    monkeypatch.undo()
    for chunks in (known, taken):
        for x in texts[::2]:
            ids, scores, _, exact = chunks.text([x])
            top, want, cost = Lattice(model).best_path(x)
            assert (ids.tolist(), scores[0], exact) == (want, top / 1e6, True) and chunks.costs[chunks[x]] == cost


def test_characters_without_any_piece_do_not_round_trip():
    v = Vocabulary(["", "a", " "], [0.0, -1.0, -1.0], {}, 0)
    known = pieces._Chunks(v, 1)
    texts = [" " + "a" * i + "x" * (i % 3 == 0) for i in range(1, 200)]
    known.learn([texts])
    assert [known.text([x])[3] for x in texts] == ["x" not in x for x in texts]


def test_one_lattice_for_many_strings(model):
    rng = random.Random(18)
    lattice = Lattice(model)
    for text in sorted("".join(rng.choices(" theraon漢", k=rng.randint(1, 40))) for _ in range(300)):
        assert lattice.n_best(text, 3) == n_best(text, model, 3)


def test_sums_of_whole_texts_against_all(spark, model):
    rng = random.Random(11)
    texts = ["".join(rng.choices([" the", " he", " in", " on", "s", "\n", "."], k=rng.randint(1, 4))) for _ in range(60)]
    for n in (1, 2, 3, 4):
        found = {r.doc_id: r for r in encode(spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], DOCS), model, n).collect()}
        got = {i: r.scores for i, r in found.items()}
        for i, t in enumerate(texts):
            every = sorted(all_segmentations(" " + t, model), key=lambda x: -x[0])
            assert got[i] == [s / 1e6 for s, _ in every[:n]]
            score_of = {ids: s / 1e6 for s, ids in every}
            spelt = [tuple(x) for x in segmentations(found[i].token_ids, found[i].others)]
            assert [score_of[x] for x in spelt] == got[i] and len(set(spelt)) == len(spelt)
            assert all(model.decode(list(x)) == t for x in spelt)


def test_generations_of_chunks_change_nothing(model, monkeypatch):
    from mediaops.llm import pieces

    rng = random.Random(19)
    words = ["".join(rng.choices("theraon漢", k=rng.randint(1, 6))) for _ in range(80)]
    texts = [[" " + w for w in rng.choices(words[i % 60 : i % 60 + 20], k=12)] for i in range(150)]

    def run():
        monkeypatch.setattr(pieces, "_held", None)
        out, seen = [], set()
        for chunks in texts:
            known = pieces._chunks(model, 3)
            seen.add(id(known))
            known.learn([chunks])
            ids, best, changes, exact = known.text(chunks)
            out.append((ids.tolist(), best, changes, exact))
        return out, len(seen)

    want, one = run()
    monkeypatch.setattr(pieces, "_KNOWN", 25)
    got, several = run()
    assert got == want and one == 1 and several > 2


def test_whole_texts_and_round_trip(spark, model):
    texts = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "▁literal mark", "\U0001f600 漢字 naïve", "x" * 60_000, "word " * 20_000, "\0control", "the house on the river"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 1), (3, texts[3], "", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = encode(df, model).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].token_ids == by_id[1].token_ids == [] and by_id[0].scores == [0.0]
    text = texts[10]
    whole = n_best(" " + text, model, 3)
    assert by_id[10].scores == [s / 1e6 for s, _ in whole] and tuple(by_id[10].token_ids) == whole[0][1]
    back = {r.doc_id: r.text for r in decode(encode(df, model), model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_empty_table(spark, model):
    assert encode(spark.createDataFrame([], DOCS), model).count() == 0


def test_long_runs_are_cut_where_no_piece_lies_across(model, monkeypatch):
    rng = random.Random(21)
    for run in ("".join(rng.choices("abcXYZ0189+/=_", k=700)), "a" * 300, "ab" * 200 + "漢" * 9 + "x" * 80, "é" * 50):
        parts = pieces.cut_long(model, run, 10)
        assert "".join(parts) == run and all(len(p) >= 10 or i == 0 for i, p in enumerate(parts))
        whole = n_best(run, model, 1)[0]
        assert whole[0] == sum(n_best(p, model, 1)[0][0] for p in parts)
        want = [n_best(run, model, 4), Lattice(model).best_path(run)]
        monkeypatch.setattr(pieces, "_LONG", 20)
        held = Lattice(model)
        assert [held.n_best(run, 4), held.best_path(run)] == want
        assert held.n_best("short", 2) == n_best("short", model, 2)
        monkeypatch.undo()


def test_five_million_characters_without_a_space(spark, model):
    rng = random.Random(22)
    texts = {1: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=5_000_000)), 2: "z" * 100_000}
    rows = encode(spark.createDataFrame([(i, t, "", 1) for i, t in texts.items()], DOCS), model).collect()
    assert all(r.round_trip and model.decode(r.token_ids) == texts[r.doc_id] and len(r.scores) == 3 for r in rows)

import random
import zlib

import pytest
from brute import bayes

from chorus.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, source string"
LETTERS = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmnoñ"}


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        words = ["".join(rng.choice(LETTERS[lang] + "xyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", ", ", "\n", " 12 "]).join(w.title() if rng.random() < 0.2 else w for w in words), lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "s") for r in rows], SCHEMA)


def run(spark, rows, **params):
    df = table(spark, rows)
    out = language.predict(df.select("doc_id", "text", "score"), language.fit(df, **params))
    assert out.columns == ["doc_id", "lang_pred", "score"]
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}


def same(got, want):
    return got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in got)


@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_equals_brute_force_and_learns(spark, monkeypatch, piece):
    monkeypatch.setattr(language, "_PIECE", piece)
    rows = corpus(300, 1)
    got = run(spark, rows, bits=12)
    assert same(got, bayes(rows, bits=12))
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i][0] == g for i, g in held) >= 0.98 * len(held)


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = corpus(200, 2)
    lies = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    assert run(spark, rows) == run(spark, lies)


def test_texts_without_letters_nulls_and_repeats(spark):
    rows = corpus(60, 3) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 _ 34 ²!", "cc"), (1003, "ab fg", None), (1004, "́", None),
                            (1005, "ΑΒΓ İı ǅ 漢字 \U0001d54f", None), (1006, "a" * 5000, "aa"), (1006, "a" * 5000, "aa"), (None, "abc", None)]
    got = run(spark, rows)
    assert same(got, bayes(rows))
    assert all(got[i] == ("und", 0.0) for i in (1000, 1001, 1002, 1004))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_empty_table_and_no_languages(spark):
    assert run(spark, []) == {}
    assert run(spark, [(i, "abc", None) for i in range(5)]) == {i: ("und", 0.0) for i in range(5)}


def test_many_languages_are_counted_whole_or_refused(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i:03}") for i in range(200)]
    got, want = run(spark, rows, bits=8), bayes(rows, bits=8)
    known = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]  # the others' languages were never seen: near ties
    assert same({i: got[i] for i in known}, {i: want[i] for i in known})
    with pytest.raises(ValueError, match="max_cells"):
        run(spark, rows, bits=8, max_cells=1000)


def test_a_very_long_word_is_one_piece():
    text = "b" * 300 + " c " * 100
    parts = [p for _, ps in language._pieces([text]) for p in ps]
    assert "".join(parts) == text

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from runloom.llm import quality
from runloom.llm.quality import Lines, measure, text_statistics

COMMON = {"en": ["the", "of", "and"], "de": ["die", "und", "für"]}
HASHES = {k: np.array(sorted(quality.word_hash(w) for w in v), np.uint64) for k, v in COMMON.items()}
PROSE = "The harbour was quiet, and the boats of the village lay still.\nNobody knew why the lamp had gone out; it was the third night.\n" * 4
CODE = "def area(w, h):\n    total = w * h\n    return total\n\nfor i in range(10):\n    print(area(i, 2))\n" * 4
KINDS = {
    "prose": (PROSE, None),
    "code": (CODE, None),
    "heading": ("# A title\n\n" + PROSE, None),
    "bullets": ("- first thing\n- second thing\n* third\n• fourth\n1. one\n12. twelve\n3) three\n" * 5, "list_share"),
    "titles": ("Broken Tramline\nSkewed Parcel\nStable Route\nNoisy Orchard\nEarly Batch\n" * 4, "list_share"),
    "csv": ("a,b,c\n1,2.5,3\n4,,6\n7,8,NaN\n" * 6, "table_share"),
    "tsv": ("1.5\t2\t3\n4\t5\t6.25\n" * 6, "table_share"),
    "pipes": ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n" * 5, "table_share"),
    "markup": ("<table>\n<tr><td>1</td><td>2</td></tr>\n</table>\n" * 6, "table_share"),
    "aligned": ("0     84.9    686.6   NA\n1     90.8     81.5   584.8\n2    896.1    211.1   404.1\n" * 5, "table_share"),
    "base64": ("kb3xP639eVqlhwnOMtTTpY9nCFx10hj6r/2HQ6x/I406UyipyFbByHXVuIMeGPx2FyV2hgZv+lMK\n" * 10, "junk_share"),
    "hex": ("00000010  3c 58 0c 55 cd 0d 30 56 9d 95 55 08 4a 3a 61 10\n" * 10, "junk_share"),
    "log": ("[22:38:21.571] W worker=26 step=1 loss=0.3157 lr=1.55e-04\n" * 10, "junk_share"),
    "progress": ("16%|########            | 1/41 [07:39<00:15, 6.40it/s]\n" * 10, "junk_share"),
    "rules": ("########################\n================================\n................\n" * 6, "junk_share"),
    "garbled": ("ÃÂ½ °©©€?�©Ð½ ™â°°ï ?ÃÐ½™€\n©™ÃÂÐ½™™��â€©�€ÃÐ°?ïÃï\n" * 8, "junk_share"),
    "repeats": ("tramline tramline tramline tramline tramline tramline\n" * 8, "junk_share"),
    "commented": ("#> 1.5,2,3\n#> 4,5,6\n" * 10, "table_share"),
    "quoted": ('  "- first thing",\n  "- second thing",\n  "- third",\n' * 6, "list_share"),
    "chinese": ("图表显示，这条曲线随着时间上升。我们先比较样本和每个月的数据。\n" * 6, None),
}


@pytest.mark.parametrize("name", KINDS)
def test_kinds(name):
    text, share = KINDS[name]
    got = {k: float(v[0]) for k, v in measure([text], HASHES).items()}
    parts = [got["list_share"], got["table_share"], got["junk_share"]]
    if share is None:
        assert sum(parts) < 0.1, got
    else:
        assert got[share] > 0.8 and sum(parts) <= 1.0 + 1e-9, got


def test_statistics():
    got = {k: v.tolist() for k, v in measure(["The cat, and the dog.\nA b", "", "x", "Die Katze und", "日本 語"], HASHES).items()}
    assert got["n_words"] == [7, 0, 1, 3, 2]
    assert got["mean_word_length"][0] == pytest.approx((3 + 4 + 3 + 3 + 4 + 1 + 1) / 7)
    assert got["punctuated_lines"] == [0.5, 0.0, 0.0, 0.0, 0.0]
    assert got["common_words"] == [pytest.approx(3 / 7), 0.0, 0.0, pytest.approx(2 / 3), 0.0]
    assert got["symbol_ratio"][1] == 0


def test_words_of_text_without_blanks(frame):
    zh = ["我们", "的", "我", "数据"]
    rows = [(1, "我们的数据很好，x"), (2, "我用numpy 的"), (3, "The cat of 日本"), (4, "好")]
    got = {r.id: r for r in text_statistics(frame(rows, "id long, body string"), "id", "body", COMMON | {"zh": zh}).collect()}
    # 我们 的 数据 很好 x; 我 用 numpy 的
    assert [got[i].n_words for i in (1, 2, 3, 4)] == [5, 4, 4, 1]
    assert [got[i].common_words for i in (1, 2, 3, 4)] == [pytest.approx(3 / 5), pytest.approx(2 / 4), pytest.approx(2 / 4), 0.0]
    assert got[1].mean_word_length == pytest.approx(9 / 5)
    alone, beside = measure(["a😀b，c"], HASHES), measure(["a😀b，c", "好"], HASHES)
    assert alone["n_words"][0] == beside["n_words"][0] == 2


@pytest.mark.parametrize("text", ["* 窗口\n* 读数的平均\n- 样本\n", "1. 窗口\n2. 读数的平均\n12. 样本\n", "1、窗口\n2．读数\n10、样本\n", "窗口大小\n读数的平均\n样本\n数据来源\n"])
def test_lists_of_text_without_blanks(text):
    assert measure([text * 5], HASHES)["list_share"][0] > 0.8


def test_wrapped_prose_of_text_without_blanks_is_no_list():
    text = "图表显示，这条曲线随着时间\n上升。我们先比较样本和每\n个月的数据，然后再看其他\n的结果；没有其他的变化。\n" * 5
    assert measure([text], HASHES)["list_share"][0] == 0


ROWS = [("17", "2024-03-02", "pump restarted after the night shift"), ("18", "2024-03-05", "the valve of the second tank was replaced"), ("19", "2024-04-01", "nothing to report from the harbour")]


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_tables_of_text(delimiter):
    text = "\n".join(delimiter.join(r) for r in ROWS * 4) + "\n"
    assert measure([text], HASHES)["table_share"][0] > 0.8 and measure([text], HASHES)["delimiter_alignment"][0] == 1.0


def test_sentences_and_code_with_as_many_delimiters_are_no_tables():
    for text in ("The pump, the valve, and the tank were old.\nThe harbour, the boats, and the lamp were new.\n" * 6, "int a; int b; int c;\nx++; y++; z++;\n" * 6, "from a import b, c, d\nfrom e import f, g, h\n" * 6):
        assert measure([text], HASHES)["table_share"][0] == 0


def test_replacement_characters_are_junk():
    assert measure(["\ufffd\ufffd\ufffd \ufffd\ufffd\n" * 10], HASHES)["junk_share"][0] > 0.8


def test_texts_do_not_touch_each_other():
    texts = [t for t, _ in KINDS.values()] + ["", "\n", "\n\n  \n", " ", "#", '"', '",', "|", "x" * 300_000, "a\tb", "\ud800", "\x00"]
    together = measure(texts, HASHES)
    for i, text in enumerate(texts):
        for name, values in measure([text], HASHES).items():
            assert values[0] == pytest.approx(together[name][i]), (i, name)


def test_every_line_has_one_label():
    for text, _ in KINDS.values():
        assert len(Lines([text]).labels()) == text.count("\n") + 1


def test_table_edges(frame):
    schema = "id long, body string, text string, item string"
    got = {r.id: r for r in text_statistics(frame([(1, None, "a", "b"), (2, "", "a", "b"), (3, PROSE, "a", "b"), (3, PROSE, "a", "b")], schema).coalesce(1), "id", "body", COMMON).collect()}
    assert got[1].n_words == 0 and got[2].junk_share == 0 and got[3].common_words > 0.2
    assert text_statistics(frame([], schema), "id", "body", COMMON).count() == 0


def test_labelled_documents():
    """Against the hand labels on which the raters agree."""
    import duckdb

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    rows = duckdb.sql(f"SELECT text, min(label <> 'prose') AS bad FROM '{folder}/documents.parquet' JOIN '{folder}/doc_labels.parquet' USING (doc_id) GROUP BY doc_id, text HAVING min(label <> 'prose') = max(label <> 'prose')").fetchall()
    got = measure([r[0] for r in rows], HASHES)
    share = got["list_share"] + got["table_share"] + got["junk_share"]
    assert ((share > 0.5) == np.array([r[1] for r in rows])).mean() > 0.99


def test_cells_stand_in_columns():
    left = "name    place     state\npump    harbour   old\nvalve   tank      new\n"
    right = "    1.5     20.25      3\n   12.5    120.25     13\n"
    ragged = "name  place  state of it\nthe old pump  of the harbour  leaks\na valve  of  a tank\n"
    assert measure([left * 4], HASHES)["delimiter_alignment"][0] > 0.9 and measure([left * 4], HASHES)["table_share"][0] > 0.9
    assert measure([right * 4], HASHES)["delimiter_alignment"][0] > 0.9
    assert measure([ragged], HASHES)["delimiter_alignment"][0] == 0


def test_rhythm_of_lines():
    steps = "first part\n    second part of it\n" * 8  # indentation and length come back every two lines
    got = measure([steps, PROSE, "", "one line", "same\n" * 20], HASHES)
    assert got["indent_periodicity"][0] > 0.8 and got["length_autocorrelation"][0] > 0.8
    assert got["indent_periodicity"][2:].tolist() == got["length_autocorrelation"][2:].tolist() == [0, 0, 0]
    assert got["list_share"][0] > 0.9
    doc, value = np.repeat([0, 2], [40, 9]), np.r_[np.tile([1.0, 2.0, 3.0, 2.5], 10), np.arange(9)]
    at = quality.autocorrelation(doc, value, 3)
    centred = value[:40] - value[:40].mean()
    assert at[0] == pytest.approx(max((centred[k:] * centred[: 40 - k]).sum() / (centred**2).sum() for k in range(1, 5))) and at[1] == 0


def statistics(rng, n):
    """Texts whose share of lists, tables and junk is noise, and whose alignment tells what they are."""
    import pandas as pd

    other = rng.random(n) < 0.4
    frame = pd.DataFrame({c: rng.random(n) * 0.2 for c in quality.PRIOR})
    frame["delimiter_alignment"] = np.where(other, 0.8, 0.1) + rng.normal(0, 0.05, n)
    frame["table_share"] = 0.45 + rng.random(n) * 0.1
    return frame, other.astype(float)


def test_the_model_learns_from_the_signals():
    rng = np.random.default_rng(5)
    seen, held = statistics(rng, 400), statistics(rng, 400)
    w = quality.fit(*seen)
    x = np.column_stack([np.log1p(held[0][c]) if c == "mean_word_length" else held[0][c] for c in quality.PRIOR] + [np.ones(400)])
    assert ((x @ w > 0) == (held[1] > 0)).mean() > 0.99
    gradient = lambda s, o, v: s.T @ (1 / (1 + np.exp(-s @ v)) - o) + quality.PRECISION * (v - np.array([*quality.PRIOR.values(), quality.PRIOR_CONSTANT]))
    seen_x = np.column_stack([np.log1p(seen[0][c]) if c == "mean_word_length" else seen[0][c] for c in quality.PRIOR] + [np.ones(400)])
    assert np.abs(gradient(seen_x, seen[1], w)).max() < 1e-6
    prior = quality.fit(seen[0].iloc[:0], seen[1][:0])
    assert prior == pytest.approx([*quality.PRIOR.values(), quality.PRIOR_CONSTANT])


def test_labels_that_disagree_or_lack_are_left_out(frame):
    rows = text_statistics(frame([(i, KINDS["csv" if i % 2 else "prose"][0]) for i in range(1, 9)], "id long, body string"), "id", "body", COMMON)
    labels = frame([(1, "a", "table"), (1, "b", "table"), (2, "a", "prose"), (3, "a", "table"), (3, "b", "prose"), (4, "a", None), (None, "a", "list"), (99, "a", "list")], "id long, rater string, label string")
    got = {r.id: r.other for r in quality.labelled(rows, "id", labels, "label", "prose").collect()}
    assert got == {1: True, 2: False}
    weights = quality.fitted(rows, "id", labels)
    assert [r.id for r in rows.where(quality.probability(weights) > 0.5).select("id").orderBy("id").collect()] == [1, 3, 5, 7]
    assert quality.fitted(rows, "id", labels.limit(0)) == pytest.approx([*quality.PRIOR.values(), quality.PRIOR_CONSTANT])

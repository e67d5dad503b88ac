from __future__ import annotations

import random
import time

import pytest

from factloom.llm import prose as P

EN = "The retained batch schedules one quiet lease, and editors explain it to the others. When a shard rejects its queue, nobody can say why the window was closed before. "
DE = "Der alte Vertrag bleibt in der Ablage, weil niemand ihn gelesen hat. Wenn die Leser fehlen, wird auch das Modul nicht geprüft. "
RU = "Каждый новый договор хранится в архиве, потому что служба не читает его сразу. Если узел не отвечает, запись остаётся на складе. "
FR = "Le vieux contrat reste dans le tiroir parce que personne ne le lit. Quand les lecteurs manquent, le module attend aussi longtemps. Personne ne sait vraiment pourquoi cela arrive. "
LIST = "\n".join(f"- {w}" for w in ("quiet lease", "old batch", "rejected queue", "window under shard", "reader: late", "three leases") * 3)
BARE = "\n".join(("Home", "Search", "Archive", "Late readers", "Old batches", "Sign in") * 3)
STOPS = "\n".join(("open the lease.", "old batch.", "reader: late.", "close every window.", "quiet queue under shard.") * 3)
TABLE = "\n".join(["| a | b | c |", "| --- | --- | --- |"] + ["| lease | 12.5 | n/a |"] * 8)
FIXED = "\n".join(["name      size      state"] + ["lease     12        n/a", "batch     7         open"] * 6)
CSV = "\n".join(["name,size,state"] + ["lease,12,n/a", "batch,,open"] * 6)
CODE = "def open_lease(batch, n=3):\n    if batch is None or n < 4:\n        raise LeaseError(f'late {n}')\n    return [close(x, 3) for x in batch]\n" * 3
CONF = "lease:\n  size: 12\n  state: \"open\"\n  owner:\n    - name: batch\n      queue: late\n" * 3
LOG = "2031-02-03T04:05:06.789Z ERROR [lease-1] batch=12 queue=late elapsedMs=3\n" * 6
JUNK = "x7cEIjuvf3ih6W0/N/O+qJO/S5cf9ye+pnqMCswEKID98nIwYl3BDRrGmJpOPYu3" * 6
SALAD = " ".join(random.Random(3).choice("the lease under every batch one until queue against open late any shard unless window a because each near".split()) for _ in range(150))
WRAP = "\n".join(EN[i : i + 40] for i in range(0, len(EN), 40))


@pytest.mark.parametrize("text", [EN * 2, DE * 2, RU * 2, FR * 2, EN.upper() * 2, EN.lower() * 2, WRAP, EN * 6 + "\n\n" + "- a lease\n- old batch", EN * 8 + "\n\n```\n" + CODE[:150] + "\n```\n", "\n".join("> " + x for x in WRAP.split("\n")), "Q: " + EN + "\n\nA: " + EN, EN * 4 + "\n\n" + TABLE[:90]])
def test_prose(text):
    assert P.measure(text)[-1] is True


@pytest.mark.parametrize("text", [LIST, BARE, STOPS, TABLE, FIXED, CSV, CSV.replace(",", ";"), CSV.replace(",", "\t"), CODE, CONF, LOG, JUNK, SALAD, "[" + '{"lease":12,"x":[null,"a"]},' * 9 + "]", EN[:75] + "\n\n" + LIST * 2, EN[:75] + "\n\n" + CODE, "~~~~~~~~\n======== 5\n........"])
def test_no_prose(text):
    assert P.measure(text)[-1] is False


def test_counts():
    m = dict(zip([x.split()[0] for x in P.DDL.split(",")][1:], P.measure("The cat sat.\n- one two\nnot 12 @x")))
    assert m["n_chars"] == 32 and m["n_words"] == 7 and m["n_lines"] == 3 and m["punct_line_share"] == pytest.approx(1 / 3) and m["list_line_share"] == pytest.approx(1 / 3)
    assert m["symbol_ratio"] == pytest.approx(1 / 32) and m["digit_ratio"] == pytest.approx(2 / 32) and m["mean_word_length"] == pytest.approx(19 / 7)


def test_table(spark):
    rows = [(1, EN * 2), (2, LIST), (3, None), (4, ""), (5, " \n\t"), (None, EN), (6, EN), (6, EN), (7, EN * 4000)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_chars int, lang string")
    got = {r["doc_id"]: r for r in P.text_stats(df).collect()}
    assert {i: r["is_prose"] for i, r in got.items()} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: True, 7: True}
    assert got[3]["n_chars"] is None and got[5]["n_chars"] == 3 and got[4]["n_words"] == 0 and P.text_stats(df).count() == 8
    assert P.text_stats(df.where("false")).count() == 0


def _without(text, *names):
    return P.measure(text, P.WEIGHTS | dict.fromkeys(names, 0.0))[-1]


MARKED = "\n".join(f"- {x}." for x in ("lease of batch", "quiet window closed", "old archive open", "late batch", "one reader") * 2)
RAGGED = "\n".join(("the lease", "an old batch within that open archive", "a queue", "the late window under a shard", "the rest", "end"))
NESTED = "\n".join(("the lease and a batch", "        old queue row", "a window of one shard", "        late readers", "the quiet reader lease", "        open records"))


@pytest.mark.parametrize("text, feature", [(MARKED, "aligned"), (RAGGED, "ragged"), (NESTED, "period")])
def test_each_feature_decides(text, feature):
    assert P.measure(text)[-1] is False and _without(text, feature) is True


@pytest.mark.parametrize("text", ["." * 200_000 + "x", " " * 200_000 + "x", "1. " * 100_000, "=" * 200_000, "…'" * 100_000, "a b c\n" * 60_000])
def test_long_texts_in_linear_time(text):
    began = time.process_time()
    P.measure(text)
    assert time.process_time() - began < 5


def test_scripts_without_spaces():
    assert P.measure("这是一个很长的句子，没有空格。第二句话也很长，说明情况。" * 9)[-1] is True
    assert P.measure("\n".join(["- 项目一", "- 项目二", "- 项目三"] * 5))[-1] is False

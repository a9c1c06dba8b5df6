import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import mojibake as M

CLEAN = {
    "de": "Schlüssel größer als üblich für Müllhalde Süd nach Änderung geprüft".split(),
    "fr": "château d’eau très abîmé à contrôler près du marché « urgent »".split(),
    "ru": "посылка проверено ночной сменой счётчик после пересчёта".split(),
    "pt": "CARTÃO NÃO CONFERIDO às três ESTAÇÃO IRMÃ balcão 25 £ · 3 µm".split(),
    "zh": ["包裹已退回，由夜班处理", "水表已检查，临时存放", "阀门重新计数，需要复核"],
    "es": "almacén añadido según plan señal ¿confirmado? pequeño baño".split(),
}
WRONG = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "utf-8", "koi8-r"), ("ru", "cp1251", "latin-1"), ("ru", "cp1251", "koi8-r"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "cp866"), ("zh", "gb18030", "latin-1"), ("zh", "utf-8", "koi8-r"), ("es", "latin-1", "cp850"), ("es", "latin-1", "cp1251"), ("pt", "utf-8", "mac-roman"), ("de", "utf-8", "cp1250")]


def corpus(n=2500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = CLEAN[rng.choice(sorted(CLEAN))]
        rows.append((i, " ".join(rng.sample(words, min(3, len(words)))) + (f" {rng.randint(1, 9999)}" if rng.random() < 0.5 else ""), False))
    for k, (lang, written, read) in enumerate(WRONG):
        for j in range(8):
            text = " ".join(rng.sample(CLEAN[lang], min(4, len(CLEAN[lang]))))
            rows.append((n + 100 * k + j, text.encode(written, "ignore").decode(read, "replace"), text != text.encode(written, "ignore").decode(read, "replace")))
    return rows


def test_every_wrong_reading_is_found_and_nothing_else(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, t string, bad boolean").withColumn("t_", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {r.id: r for r in M.garbled(df, "id", "t").collect()}
    truth = {i for i, _, bad in rows if bad}
    assert len(truth & got.keys()) >= 0.98 * len(truth) and not got.keys() - truth
    restored = [got[i].restored for i in truth & got.keys() if got[i].restored]
    assert len(restored) > 50


def test_edges(spark):
    rows = corpus()[:2500] + [(-1, None, False), (-2, "", False), (-3, "plain text?", False), (-4, "gepr�ft", True), (-5, "usuni?to", True), (-5, "usuni?to", True), (-6, "Schlüssel " * 20_000, False), (-7, "锟斤拷", True), (-8, "geprÃ¼ft " * 3000, True)]
    df = spark.createDataFrame([r[:2] for r in rows], "id bigint, t string")
    got = [(r.id, r.restored) for r in M.garbled(df, "id", "t").collect() if r.id < 0]
    assert sorted(i for i, _ in got) == [-8, -7, -5, -5, -4] and dict(got)[-4] is None and dict(got)[-8] == "geprüft " * 3000


def test_empty(spark):
    assert M.garbled(spark.createDataFrame([], "id bigint, t string"), "id", "t").count() == 0


@pytest.mark.parametrize("read", M.READ_AS_SINGLE)
def test_automaton_decodes_spans_only(read):
    table = {b: c for c, b in M._table(read).items()}
    text = "a " + "".join(table[b] for b in "ü中".encode()) + " z"
    assert M.decode_spans(text, M.to_bytes(text, read), M.UTF8_SPANS, "utf-8") == ("a ü中 z", 5, 2)


def test_spans_in_a_part_of_a_word(spark):
    parts = [
        ("水表已检查，", "临时存放包裹", "", "utf-8", "gb18030"),
        ("水表已检查，", "包裹已退回", "", "gb18030", "latin-1"),
        ("包裹", "阀门重新计数", "夜班", "gb18030", "cp1252"),
        ("", "d’eau", "", "utf-8", "gb18030"),
        ("水表已检查，" * 40, "临时存放包裹", "", "utf-8", "gb18030"),
    ]
    clean = [(i, t) for i, t, _ in corpus()[:2500]] + [(3000 + i, f"{a}{b}{c}") for i in range(20) for a, b, c, _, _ in parts]
    bad = [(-1 - i, a + b.encode(written).decode(read) + c) for i, (a, b, c, written, read) in enumerate(parts)]
    got = {r.id: r.restored for r in M.garbled(spark.createDataFrame(clean + bad, "id bigint, t string"), "id", "t").collect()}
    assert got == {-1 - i: a + b + c for i, (a, b, c, _, _) in enumerate(parts)}


def test_question_marks_for_letters_of_a_known_word(spark):
    rows = [(i, t) for i, t, _ in corpus()[:2500]] + [(3000, "skrzynia na żądanie"), (3001, "Größe und łódzka"), (3002, "chodź, wie wieś"), (3003, "ça d’été")]
    bad = [(-1, "skrzynia gotowe na ??danie"), (-2, "Gr??e"), (-3, "ulica ?ódzka,"), (-4, "????????? ????????? сменой"), (-5, "?? ??????? ????"), (-6, "???????????"), (-7, "d?été".replace("?", "’").encode("latin-1", "replace").decode("latin-1"))]
    fine = [(-20, "wie?"), (-21, "wie ??"), (-22, "¿confirmado?"), (-23, "vrai ?"), (-24, "Schlüssel?"), (-25, "x??y"), (-26, "包裹已退回?")]
    got = {r.id: r.restored for r in M.garbled(spark.createDataFrame(rows + bad + fine, "id bigint, t string"), "id", "t").collect()}
    assert got == {i: None for i, _ in bad}


def test_question_marks_between_two_words_are_no_loss(spark):
    rows = [(i, t) for i, t, _ in corpus()[:2500]] + [(3000, "why because of the flood")]
    asked = [(-1, "why?because"), (-2, "usuni?to"), (-3, "because?why")]
    got = {r.id for r in M.garbled(spark.createDataFrame(rows + asked, "id bigint, t string"), "id", "t").collect()}
    assert got == {-2}


def test_long_words_and_text_garbled_many_times(spark):
    rng = random.Random(4)
    long = lambda: "-".join(rng.choices(CLEAN["ru"], k=300))
    bad = [(-1, long().encode().decode("cp1251", "ignore"))]
    many = "größer"
    for _ in range(5):
        many = many.encode().decode("latin-1")
    rows = [(i, t) for i, t, _ in corpus()[:2500]] + [(3000 + i, long()) for i in range(5)] + bad + [(-3, many)]
    got = {r.id: r.restored for r in M.garbled(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    assert got.keys() == {-1, -3} and got[-3] == "größer"


def test_two_models_in_one_worker(spark):
    one = spark.createDataFrame([(i, t) for i, t, _ in corpus()[:2500]] + [(-1, "geprÃ¼ft")], "id bigint, t string").coalesce(1)
    two = spark.createDataFrame([(i, "geprÃ¼ft") for i in range(300)], "id bigint, t string").coalesce(1)
    first, second = M.garbled(one, "id", "t"), M.garbled(two, "id", "t")
    plain = [sorted(r.id for r in x.collect()) for x in (first, second)]
    assert plain[0] == [-1] and [sorted(r.id for r in x.collect()) for x in (first, second, first)] == [*plain, plain[0]]

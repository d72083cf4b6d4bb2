import pytest

from brackenfold.llm import encoding as en

TEXTS = [
    "Elle répondit : « Le découpage a été vidé. »",
    "The operator’s note says: “Restart the lock file first.”",
    "Почему загрузчик файлов растёт после 5 удалений?",
    "Γιατί μεγαλώνει ο έλεγχος κλειδιού;",
    "为什么检查点在14次更新后变大？",
    "担当者は「復旧処理を止めて。」と書いた。",
    "لماذا يكبر الفهرس بعد 20 تعديلات؟",
    "왜 복구 단계가 커집니까? 검색 그래프는 쓰지 않습니다.",
    "Größere Dateien übergeht der Größenfilter vollständig – für 5 €.",
]


def misread(text, codec, writer="utf-8"):
    table = {b: c for c, b in en.bytes_of(codec).items()}
    return "".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in text.encode(writer))


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_round_trip(text, codec):
    garbled, restored, layers, before, after = en.repair(misread(text, codec))
    assert garbled and before > after
    if codec == "cp1252":
        assert restored == text and after == round(en.text_cost(text), 3)


@pytest.mark.parametrize("text", TEXTS)
def test_right_texts_stay(text):
    assert en.repair(text)[:2] == (False, text)


def test_nested_layers():
    text = "A naïve cache – twice."
    twice = misread(misread(text, "cp1252"), "cp1252")
    garbled, restored, layers, *_ = en.repair(twice)
    assert garbled and restored == text and len(layers) == 2


@pytest.mark.parametrize("text, codec", [("为什么检查点在14次更新后变大？", "gb18030"), ("担当者は復旧処理を止めて検索グラフを確認した", "cp932"), ("Почему загрузчик файлов растёт после удалений", "cp1251")])
def test_other_encodings_read_as_latin(text, codec):
    read = "".join({b: c for c, b in en.bytes_of("cp1252").items()}.get(b, chr(b)) for b in text.encode(codec))
    assert en.repair(read)[:2] == (True, text)


@pytest.mark.parametrize(
    "text",
    [
        'A reader saw "Ã©" where "é" was meant; the loader now asks for UTF-8.',
        "The bytes c3 a9 show up as Ã© in a broken viewer, but the log itself is fine.",
        "Câmpul „Ânâ” și râul sunt nume de test.",
        "Â la carte: © 2026, ® mark, ± 0.5 µs, ½ page",
        "┌────┬────┐ │ id │ ok │ └────┴────┘",
        "NÃO APAGUE “A VERIFICAÇÃO” «CAFÉ» NÓ\xa0DE",
        "« Le segment a été vidé\xa0» — État",
        "Þórð and Ævar tested ð, þ and æ",
        "plain ascii",
        "",
    ],
)
def test_unusual_texts_stay(text):
    assert en.repair(text)[:2] == (False, text)


def test_lost_characters_are_named():
    garbled, restored, _, before, after = en.repair("Les donn�es d�j� v�rifi�es")
    assert garbled and after == before >= 5 and "�" in restored
    assert en.repair("disse Grialle Ã equipe")[:3] == (True, "disse Grialle à equipe", ["blank in a sequence"])


RUSSIAN = "Почему загрузчик файлов растёт после пяти удалений? Каждый журнал записи хранит строки."
GERMAN = "Größere Dateien übergeht der Prüfpunkt vollständig, für Löschungen gilt die Übersicht."
SWAPS = [(RUSSIAN, w, r) for w in ("koi8_r", "cp1251", "cp866", "iso8859_5") for r in ("cp1251", "koi8_r", "cp1252", "cp866") if r != w]
SWAPS += [(GERMAN, "cp1252", "cp850"), (GERMAN, "cp1252", "cp437"), (GERMAN, "cp850", "cp1252"), ("平均延迟从一毫秒下降，检查点在更新后变大。", "gb18030", "cp1252"), ("왜 복구 단계가 커집니까? 검색 그래프는 쓰지 않습니다.", "cp949", "cp1252")]


@pytest.mark.parametrize("text, writer, reader", SWAPS)
def test_any_writer_read_as_any_reader(text, writer, reader):
    garbled, restored, layers, before, after = en.repair(misread(text, reader, writer))
    assert garbled and before > after
    words = text.split()
    assert sum(a == b for a, b in zip(words, restored.split())) >= 0.6 * len(words)


@pytest.mark.parametrize("text", [RUSSIAN, GERMAN, TEXTS[0], TEXTS[3]])
@pytest.mark.parametrize("reader", ["koi8_r", "cp866", "cp1250", "cp1256", "gb18030", "cp850"])
def test_utf8_read_as_anything(text, reader):
    assert en.repair(text.encode().decode(reader, "replace"))[0]


def test_character_references():
    for read in ("donn&#195;&#169;es d&#xC3;&#xA9;j&#195;&#160; l&#226;&#8364;&#8482;index", "donn&Atilde;&copy;es d&amp;#195;&amp;#169;j&Atilde;&nbsp; l&acirc;&euro;&trade;index"):
        assert en.repair(read)[:2] == (True, "données déjà l’index")
    for right in ("donn&eacute;es &#233;t&#233; &amp; &#8364; 5", "AT&T; &nbsp;&copy; 2026", "&#20013;&#25991;"):
        assert en.repair(right)[:2] == (False, right)


def test_a_part_of_a_text():
    bad = RUSSIAN.encode("koi8_r").decode("cp1251")
    assert en.repair(f"{RUSSIAN} {bad} {RUSSIAN}")[:2] == (True, f"{RUSSIAN} {RUSSIAN} {RUSSIAN}")


def test_utf16_bytes():
    assert en.repair("Größe 5".encode("utf-16-le").decode("latin-1"))[:2] == (True, "Größe 5")


def test_cost_knows_no_encoding():
    for text in [*TEXTS, RUSSIAN, GERMAN]:
        for reader, writer in (("cp1252", "utf-8"), ("cp1251", "koi8_r"), ("cp437", "cp1252")):
            try:
                bad = text.encode(writer).decode(reader)
            except UnicodeError:
                continue
            if bad != text:
                assert en.text_cost(bad) > en.text_cost(text)


def test_operator(spark):
    rows = [(1, "cachÃ©", "x", 1), (1, "cachÃ©", "x", 1), (2, None, "y", 2), (3, "", None, 3), (4, "naïve", "z", 4), (5, "naïve " * 30_000 + "x" * 100_000, "w", 5), (6, "d�j�", "v", None)]
    got = en.find_garbled(spark.createDataFrame(rows, "vec_id int, text string, restored string, cost_before int"))
    assert got.columns == ["vec_id", "text", "restored_in", "cost_before_in", "restored", "layers", "cost_before", "cost_after"]
    assert sorted((r["vec_id"], r["restored"], r["cost_after"]) for r in got.collect()) == [(1, "caché", 0.3), (1, "caché", 0.3), (6, "d�j�", 16.0)]
    assert en.find_garbled(spark.createDataFrame([], "text string")).count() == 0

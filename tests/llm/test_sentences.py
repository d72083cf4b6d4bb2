import pytest
from pyspark.sql import functions as F

from brackenfold.llm.sentences import sentences

CASES = {
    "Dr. Marewick measured 9.4 ms for No. 3, i.e. by 2.4 kB. The U.S. mirror lags, cf. rank_chunk.py and a.b.": ["Dr. Marewick measured 9.4 ms for No. 3, i.e. by 2.4 kB.", "The U.S. mirror lags, cf. rank_chunk.py and a.b."],
    'A. Draewic wrote it; B. C. Velick did not. "Is it ready?" asked Solavel at 6 p.m. on Monday. “Done.” Next one…': ["A. Draewic wrote it; B. C. Velick did not.", '"Is it ready?" asked Solavel at 6 p.m. on Monday.', "“Done.”", "Next one…"],
    "It waits... and then goes on. flush_header.json holds it! (It is optional.) See https://a.b/c.d?e=f. End": ["It waits... and then goes on.", "flush_header.json holds it!", "(It is optional.)", "See https://a.b/c.d?e=f.", "End"],
    "Am 3. Mai gilt Nr. 5, vgl. Abb. 7 und S. 285. Es wird z. B. neu geöffnet, d. h. „Läuft es noch?“, fragte er. Töne usw. Das Ende.": ["Am 3. Mai gilt Nr. 5, vgl. Abb. 7 und S. 285.", "Es wird z. B. neu geöffnet, d. h. „Läuft es noch?“, fragte er.", "Töne usw.", "Das Ende."],
    "Elle répondit : « Le segment a été vidé. » « Est-il prêt ? » demanda M. Dupont hier. Fin": ["Elle répondit : « Le segment a été vidé. »", "« Est-il prêt ? » demanda M. Dupont hier.", "Fin"],
    "Файлы и т. д. Проф. Иванов описал, т. е. в 2019 г. для архива. «Готов ли он?» — спросил он. Да.": ["Файлы и т. д.", "Проф. Иванов описал, т. е. в 2019 г. для архива.", "«Готов ли он?» — спросил он.", "Да."],
    "Γιατί μεγαλώνει; «Είναι έτοιμος;» ρώτησε χθες. Κρατά π.χ. τις νέες· δείτε τη σελ. 8.": ["Γιατί μεγαλώνει;", "«Είναι έτοιμος;» ρώτησε χθες.", "Κρατά π.χ. τις νέες· δείτε τη σελ. 8."],
    "她写道：“先停止目录。”“准备好了吗？”Halewick问道。（可以省略。）版本3.1不再使用……平均从0.9降到4.6！": ["她写道：“先停止目录。”", "“准备好了吗？”Halewick问道。", "（可以省略。）", "版本3.1不再使用……", "平均从0.9降到4.6！"],
    "担当者は「止めて。」と書いた。「できたか？」とVelickは尋ねた。次。": ["担当者は「止めて。」と書いた。", "「できたか？」とVelickは尋ねた。", "次。"],
    "ระบบอ่าน flush_a.toml แล้วสร้างใหม่ เวลาลดลงเหลือ 0.95 มิลลิวินาที ทำไม": ["ระบบอ่าน flush_a.toml แล้วสร้างใหม่", "เวลาลดลงเหลือ 0.95 มิลลิวินาที", "ทำไม"],
    "«هل الملف جاهز؟» سأل الفريق مساءً. قال د. Tamorra انظر ص. 2 من الدليل. لماذا؟": ["«هل الملف جاهز؟» سأل الفريق مساءً.", "قال د. Tamorra انظر ص. 2 من الدليل.", "لماذا؟"],
    'डॉ. Solenn ने 0.15 मि.से. का समय मापा। "क्या तैयार है?" टीम ने पूछा। v1.2 में बदल गए।': ["डॉ. Solenn ने 0.15 मि.से. का समय मापा।", '"क्या तैयार है?" टीम ने पूछा।', "v1.2 में बदल गए।"],
    "지우지 마세요! v1.2 버전부터 쓰지 않습니다. 3.4 ms로 줄었습니다.": ["지우지 마세요!", "v1.2 버전부터 쓰지 않습니다.", "3.4 ms로 줄었습니다."],
    "# Heading 1\nText goes\non here. Two\nlines.\n\n- first entry\n  goes on\n* “Second, with a dot.”\n\nLast": ["# Heading 1", "Text goes\non here.", "Two\nlines.", "- first entry\n  goes on", "* “Second, with a dot.”", "Last"],
    "He said: “Stop. Wait a bit. Go.” Then he left.": ["He said: “Stop. Wait a bit. Go.”", "Then he left."],
    "   \n ": [],
    "": [],
    "no end": ["no end"],
}


def test_cases(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in sentences(df).orderBy("doc_id", "start_char").collect():
        assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["sentence"]
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == CASES[t], t


def test_lines_of_notes(spark):
    text = "yes. the cache was empty. fixed.\n+1\nno idea... maybe the log\nHmm. Not sure. Ask Sue at 6 p.m. today\n"
    df = spark.createDataFrame([(1, text, "note"), (2, text, None)], "doc_id bigint, text string, kind string")
    got = [r["sentence"] for r in sentences(df, by_line=F.col("kind") == "note").where("doc_id = 1").orderBy("start_char").collect()]
    assert got == ["yes.", "the cache was empty.", "fixed.", "+1", "no idea... maybe the log", "Hmm.", "Not sure.", "Ask Sue at 6 p.m. today"]


@pytest.mark.parametrize("text", [" private  use. Yes it is.", "🎉 one. 🎉 Two! é漢 x. Y"])
def test_offsets_count_code_points(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sentences(df).orderBy("start_char").collect()
    assert rows[-1]["end_char"] == len(text) and all(text[r["start_char"] : r["end_char"]].strip() == text[r["start_char"] : r["end_char"]] for r in rows)


@pytest.mark.parametrize("opening, closing", ["“”", "«»"])
@pytest.mark.parametrize("n", [3, 30, 3000])
def test_quotations_of_any_length(spark, opening, closing, n):
    text = f"The reader said: {opening}" + " ".join(["Nothing is lost here."] * n) + f"{closing} Then it ended."
    got = sentences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("start_char").collect()
    assert len(got) == 2 and got[-1]["sentence"] == "Then it ended."


def test_substitutes_in_a_text_come_out_as_they_were(spark):
    from brackenfold.llm import sentences as se

    text = f"Dr. A{se.SPARE[0]}b. {se.DOT}Two{se.SPARE} {se.END}x {se.JOIN}. Three 0.5 here."
    got = [r["sentence"] for r in sentences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("start_char").collect()]
    assert "".join("".join(got).split()) == "".join(text.split())


def test_khmer_and_burmese_end_at_their_marks(spark):
    rows = [(1, "ខ្ញុំ ទៅ ផ្សារ។ គាត់ នៅ ផ្ទះ។"), (2, "ကျွန်တော် သွား သည်။ သူ နေ သည်။")]
    got = sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 2, 2: 2}


def test_nulls_long_and_extra_columns(spark):
    rows = [(1, None, 1), (None, "A b. C d.", 2), (2, "X y. Z w.", 3), (2, "X y. Z w.", 3), (3, "A sentence here. " * 3000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_char int")
    counts = {r["doc_id"]: r["count"] for r in sentences(df).groupBy("doc_id").count().collect()}
    assert counts == {None: 2, 2: 4, 3: 3000}
    assert sentences(df.where("false")).count() == 0


def test_query_covers_all_kinds(spark, tmp_path):
    from brackenfold.llm import queries_text as qt

    kinds = ["prose", "note", "page", "code", "dump", None]
    rows = [(i, "One here. Two here.", k) for i, k in enumerate(kinds)] + [(9, "  ", "page")]
    spark.createDataFrame(rows, "doc_id bigint, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    count = lambda q: {r["doc_id"]: r["count"] for r in q(spark, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert count(qt.p8_sentences) == {i: 2 for i in range(6)}
    assert count(qt.p8_found) == {0: 2, 1: 2}

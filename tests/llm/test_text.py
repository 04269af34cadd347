"""Personal information and sentence units."""

from corvane.llm import personal_info as pi, sentences as sn

PII = [
    ("Please write to joskin at quickmail dot test, I never got an answer.", [("email", "joskin at quickmail dot test")]),
    ("Contact: cordrine-ubel[at]mailbox[dot]example thanks", [("email", "cordrine-ubel[at]mailbox[dot]example")]),
    ("Answers to petrika.grel (at) inbox.test only", [("email", "petrika.grel (at) inbox.test")]),
    ("<arbeline+news@inbox.test>", [("email", "arbeline+news@inbox.test")]),
    ("Rated 4.5 @ launch, now 3.6 with 94343 votes.", []),
    ("Call me on (555) 011-9636 after six.", [("phone", "(555) 011-9636")]),
    ("It dialled +49 30 23125 403 by itself.", [("phone", "+49 30 23125 403")]),
    ("My number is five five five zero one two three four five six now", [("phone", "five five five zero one two three four five six")]),
    ("The log says 10.72.26.66 refused port 7549. Order 1436-5336. Ticket TCK-967-0648. Activation code 9191 5403 7512 did nothing.", []),
    ("driver licence 0094 0229 8546 got rejected twice", [("id_number", "0094 0229 8546")]),
    ("It put QQ 20 40 13 B (my identity card) into the export.", [("id_number", "QQ 20 40 13 B")]),
    ("Insured person 52M587468-5: record not found.", [("id_number", "52M587468-5")]),
    ("I live at Flat 24, 152 Harrowside Close and the map shows a lake.", [("address", "Flat 24, 152 Harrowside Close")]),
    ("Parcel was meant for 119 Millbrook Rd. and came back.", [("address", "119 Millbrook Rd.")]),
    ("Meine Anschrift ist Harrowridgestraße 102 und nicht die alte.", [("address", "Harrowridgestraße 102")]),
    ("Parcel was meant for 21, rue Juniperwick and came back.", [("address", "21, rue Juniperwick")]),
    ("It still has Calle Willowwick 11 as my home.", [("address", "Calle Willowwick 11")]),
    ("It took Page 63 Main Menu to find the Glimabi Road theme.", []),
    ("Ms Cordrine Wethovic promised a refund. Mr. Lundgard closed my ticket unread.", [("name", "Cordrine Wethovic"), ("name", "Lundgard")]),
    ("Ask for elsabeth tarnbray-sorrenmoor when you call them.", [("name", "elsabeth tarnbray-sorrenmoor")]),
    ("Viele Grüße, O. TARNSTAD", [("name", "O. TARNSTAD")]),
    ("The pinned cache -- SIDEBAR ROADMAP -- hides it.", []),
]


def test_items():
    for text, want in PII:
        assert [(k, text[a:b]) for k, a, b in pi.find(text)] == want, text


def test_offsets_survive_normalisation():
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "12345")
    text = f"Tél ré́p : it dialled +49 30 {wide} 403 by itself, write to а.bс@mailbox.test please"
    got = [(k, text[a:b]) for k, a, b in pi.find(text)]
    assert got == [("phone", f"+49 30 {wide} 403"), ("email", "а.bс@mailbox.test")]


def test_redacted(spark):
    rows = [(1, "Call me on (555) 011-9636 after six."), (2, None), (3, ""), (4, "plain"), (5, "ask " * 50_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "review_id bigint, review_text string, kind string")
    got = {r["review_id"]: r["review_text"] for r in pi.redacted(df).collect()}
    assert got[1] == "Call me on [PHONE] after six." and got[2] is None and got[3] == "" and got[4] == "plain"
    assert [tuple(r)[:3] for r in pi.items(df).collect()] == [(1, "phone", "(555) 011-9636")]
    assert pi.items(df.limit(0)).count() == 0


UNITS = [
    ["Setup diary 13.3.13", "Dr. Osterfeld of Caskiwyn Inc. called it sensible.", "It handles the export, the cache, etc.", "We paid 9."],
    ['"Does it ever finish?" asked my aunt.', "lutnelod hides the button.", "(It forgets my choices.)", "J. K. Maskbray (a tester, not a fan!) liked it!! 😡", "Next one."],
    ["Sie schrieb: „Nie wieder! Schade um die Suche.“", "Der 2. Versuch war gut.", "Das sind ca. 9,4 GB, d. h. mehr als früher."],
    ["同事说：“语音输入很慢。以后再也不用了！”", "“能用吗？”朋友问我。", "（更新以后很好。）", "我付了9.5元，一般……", "很好。"],
    ["姉は「快適です。もう使いません。」と言いました。", "「動きますか？」と聞かれました。"],
    ['"बहुत धीमा है।" मेरी बहन ने लिखा।', "क्या यह तेज़ है?", "डॉ. Tarnstad ने कहा!"],
    ["كتبت أختي: «شيء ممتاز. لن أعود!»", "هل هو جيد؟", "قال د. Ubelbray إن الأداء جيد."],
    ["Есть просмотр цветов и т. д.", "Нужно ок. 2,16 ГБ, т. е. больше.", "В 2024 г. список вырос."],
]


def test_units():
    texts = []
    for units in UNITS:
        glue = "" if any("぀" <= c <= "鿿" for c in units[0]) else " "
        texts.append(glue.join(units))
    stats = sn.learn_words([" ".join(["when the aunt asked me and the tester liked it"] * 6)])
    chain = sn.train(texts * 3, stats)
    for units, text in zip(UNITS[1:], texts[1:]):
        assert [text[a:b] for a, b in sn.units(text, chain, stats)] == units
    lines = "Notes\n\nThings I noticed:\n- one. two\n- i tried it\n\nThis line is\nwrapped here. Done.Then more."
    chain = sn.train([*texts, lines] * 3, stats)
    assert [lines[a:b] for a, b in sn.units(lines, chain, stats)] == ["Notes", "Things I noticed:", "- one. two", "- i tried it", "This line is\nwrapped here.", "Done.", "Then more."]


def test_unpunctuated_script():
    good = "ทำไมการซิงค์ช้ามากครับ? ผมใช้ Pim 7 วันแล้วปฏิทินดีมากค่ะ? รุ่น 2.1 ทำให้การค้นหาดีมากครับ?\n\nเมื่อวานปฏิทินดีมากค่ะ"
    stats = sn.learn_words([good] * 4)
    chain = sn.train([good] * 4, stats)
    bare = "ทำไมปฏิทินช้ามากครับ รุ่น 3.2 ทำให้การซิงค์ดีมากค่ะ ผมใช้ Zor 9 วันแล้วดีมากครับ"
    assert [bare[a:b] for a, b in sn.units(bare, chain, stats)] == ["ทำไมปฏิทินช้ามากครับ", "รุ่น 3.2 ทำให้การซิงค์ดีมากค่ะ", "ผมใช้ Zor 9 วันแล้วดีมากครับ"]


def test_sentence_table(spark):
    rows = [(1, " One. Two. "), (2, None), (3, ""), (4, " \n "), (5, "word " * 60_000), (1, " One. Two. ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, unit int")
    got = sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in sn.sentence_units(df).collect())
    assert got == [(1, 1, 5), (1, 1, 5), (1, 6, 10), (1, 6, 10), (5, 0, 299_999)]
    assert sn.sentence_units(df.limit(0)).count() == 0


def test_rare_script_is_counted_whole(spark):
    """Four Thai texts among 400 others: a draw of 20 documents has to know their endings."""
    thai = ["ทำไมการซิงค์ช้ามากครับ? ผมใช้ Pim 7 วันแล้วปฏิทินดีมากค่ะ? รุ่น 2.1 ทำให้การค้นหาดีมากครับ?", "เมื่อวานปฏิทินดีมากครับ ทำไมการส่งออกใช้ยากค่ะ? ผมใช้ Zor 9 วันแล้วดีมากค่ะ?"] * 2
    bare = "ทำไมปฏิทินช้ามากครับ รุ่น 3.2 ทำให้การซิงค์ดีมากค่ะ ผมใช้ Zor 9 วันแล้วดีมากครับ"
    rows = [(k, f"It helps on day {k}. The tester liked it.") for k in range(400)] + [(1000 + k, t) for k, t in enumerate([*thai, bare])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sn.fit(df, sample=20)[1].__dict__ == sn.learn_words([t for _, t in rows]).__dict__
    got = sorted((r["start_char"], r["end_char"]) for r in sn.sentence_units(df, sample=20).where("doc_id = 1004").collect())
    assert [bare[a:b] for a, b in got] == ["ทำไมปฏิทินช้ามากครับ", "รุ่น 3.2 ทำให้การซิงค์ดีมากค่ะ", "ผมใช้ Zor 9 วันแล้วดีมากครับ"]


def test_removed_marks_are_labels():
    """An ending that no list holds is a boundary where its mark was taken away."""
    text = "ปฏิทินดีมากจริง! ผมใช้ Zor 9 วันแล้วดีมากครับ"
    seq = sn._sequences([text], sn.Stats(endings=frozenset({"รับ"})))
    labels = next([(c, y) for c, y in part if c[0] == "t"] for part in seq if any(c[0] == "t" and c[1].endswith("ริง") for c, _ in part))
    assert [y for c, y in labels if "s3:ริง" in sn.features(c)] == [1] and sum(y for _, y in labels) == 1


#: Hand-labelled, not seen in training: a bar where a unit ends.
HELD_OUT = (
    "The sidebar froze.| We asked Dr. Quillby, who said it was fine.| It cost 40.| Nobody paid.",
    "\"It is slow. I left.\"| My cousin agreed.| \"Is it?\" asked Mrs. Tarn.| (She was right.)| We stayed…| and it got better!",
    "They keep mugs, trays, etc. in the hall.| It opens at 8 a.m.| T. Ambrey wrote that.|Then he left.| Why?| 5 of us know.",
    "Der Drucker hängt.| Am 4. April kam Hr. Tarn mit Nr. 7.| „Gut so!“ rief er.| Es gibt Teller usw.| Wir zahlten 50.| Danach ging es… und ging.",
    "Elle dit « C'est bon. Je reste. » et sourit.| M. Tarn est parti.| Pourquoi ?| La page 4 manque.| Voir p.ex. la note.| Fini.",
    "La Sra. Tarn escribió «No. Nunca.»| Luego llamó.| ¿Quién?| Costó 40.| Véase la pág. 9.| Nada…| Fin.",
    "Она ушла.| — Это он, — сказал брат.| В 2021 г. стало тише.| Есть чашки и т. д.| Он спросил «Где?»| Потом лёг.",
    "老板说：“太慢。不买了！”|后来他买了。|“为什么？”我问。|（没人知道。）|价格是4.5元。|好吧……|算了。",
    "店長は「速い。安い。」と言った。|「本当？」私は聞いた。|（誰も知らない。）|値段は4.5円。|まあ……|いいか。",
    "\"यह सस्ता है।\" पिता ने कहा।| क्यों?| डॉ. टार्न आए।| फिर गए।",
    "قال أبي: «رخيص. سأشتري!»| لماذا؟| جاء د. تارن.| ثم ذهب.",
    "Tools:|\n- a saw. small|\n- a nail|\n\nWe built\nit ourselves.| It holds.",
)


def test_held_out_texts():
    words = " ".join(["when the aunt and who it that is was in of to we and und y et und i ging got went better danach luego puis"] * 6)
    stats = sn.learn_words([f"We {words}"])
    chain = sn.train(["The export works. It is fine. We like it.", "Er kam. Sie ging. Es war gut."], stats)

    def score(tag):
        hit = n = m = 0
        for text in HELD_OUT:
            bare, places = sn._marked(text)
            found = sn.candidates(bare, stats)
            got = {e for (e, _), y in zip(found, tag([c for _, c in found])) if y}
            hit, n, m = hit + len(got & places), n + len(got), m + len(places)
        return hit / m, hit / n

    recall, precision = score(chain.decode)
    rule_recall, rule_precision = score(lambda cs: [sn.obvious(c) == 1 for c in cs])
    print("held out", recall, precision, "contexts alone", rule_recall, rule_precision)
    assert recall >= 0.97 and precision >= 0.97 and recall > rule_recall + 0.1


def test_every_disguise_is_tried():
    for text, want in [
        ("It is oh seven seven one two three four six eight one three now", [("phone", "oh seven seven one two three four six eight one three")]),
        ("It is (seven seven one-two-three four six eight one three).", [("phone", "seven seven one-two-three four six eight one three")]),
        ("Mail jane at example [dot] com please", [("email", "jane at example [dot] com")]),
        ("Mail jane <at> example.com please", [("email", "jane <at> example.com")]),
        ("Mail jane (ät) example.de please", [("email", "jane (ät) example.de")]),
        ("Mail jane { at } example.de please", [("email", "jane { at } example.de")]),
        ("Call (+49) 170 1234567 today", [("phone", "(+49) 170 1234567")]),
        ("Call (030) 345 67 today", [("phone", "(030) 345 67")]),
        ("Call (02) 345 67 today", [("phone", "(02) 345 67")]),
        ("Two or three of one dozen, one two three four five six", []),
    ]:
        assert [(k, text[a:b]) for k, a, b in pi.find(text)] == want, text


def test_disguises_and_names_by_context():
    cases = {
        "two one three four six seven eight two three six": [("phone", "two one three four six seven eight two three six")],
        "mail joskin at quickmail d\u043et test now": [("email", "joskin at quickmail d\u043et test")],
        "write joskin [\u0430t] mailbox [dot] test now": [("email", "joskin [\u0430t] mailbox [dot] test")],
        "jane <at> example.com": [("email", "jane <at> example.com")],
        "(+49) 170 1234567 bitte": [("phone", "(+49) 170 1234567")],
        "Our colleague Cordrine Wethovic found it": [("name", "Cordrine Wethovic")],
        "mein Kollege Hans Meier schrieb das": [("name", "Hans Meier")],
        "yesterday J. Smith fixed it": [("name", "J. Smith")],
        "THE DARK IMPORT -- FEELS ERRATIC UNLESS THE INDEX": [],
        "and that is bewildering 90 for a year": [],
        "my passport X44196886 got rejected twice I left 5550174451 with them": [("id_number", "X44196886"), ("phone", "5550174451")],
    }
    for text, want in cases.items():
        assert [(k, text[a:b]) for k, a, b in pi.find(text)] == want, text

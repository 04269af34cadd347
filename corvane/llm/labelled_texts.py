"""Hand-labelled texts for the sentence tagger: a bar stands where a unit ends. Written for this purpose."""

LABELLED = (
    # points after words, before small letters, digits, capitals and without a space
    "The export works fine.| but the import does not.| we use both every day.| The rest is good.",
    "It froze twice.| 14 files were lost.| Then it came back.| 3 of them were empty.",
    "The update broke the menu.|Then everything was slow.|The old one was better.",
    "It saves me time.|I use it daily.|A friend showed it to me.| Fine.",
    "See www.example.org or read the file notes.txt first.| Version 2.5.1 is old.| The build 10.3 is new.",
    "Er lief gut.| danach nicht mehr.| Die Karte fehlt.| Das Menü auch.|Der Rest ist gut.",
    "Funciona bien.| pero tarda mucho.| La copia falla.|El resto sirve.| Nada más.",
    "Il marche bien.| mais il est lent.| La carte manque.|Le reste va bien.| Rien à dire.",
    "Всё работает.| но медленно.| Карта пропала.|Меню тоже.| Больше ничего.",
    # abbreviations that a sentence does not end with, also before capitals
    "We met Dr. Halvorn and Mr. Tessing at the desk.| Prof. Linde was late.| Mrs. Arno came with Ms. Okel.",
    "It needs approx. 20 minutes, cf. the notes on p. 4 and fig. 3.| See vol. 2, e.g. Chapter 9, i.e. the last.| No. 5 is the best.",
    "Das Gerät (Nr. 12) kam am Montag, z.B. mit Kabel, bzw. ohne.| Es kostet ca. 20 Euro, d.h. wenig.| Fr. Linde und Hr. Arno fragten.",
    "La Sra. Linde llamó al Sr. Arno.| Véase la pág. 4, p.ej. la tabla.| El Dr. Okel dijo que no.",
    "M. Arno et Mme. Linde sont venus.| Voir p.ex. la page 4, env. 20 lignes.| Le Dr. Okel est parti.",
    "Мы были на ул. Мира, стр. 5, т.е. рядом.| Им. Ленина стоит там.| Г-н. Арно пришёл.",
    "डॉ. अरनो और श्री. लिंडे आए।| वे देर से आए।| सब ठीक है।",
    # abbreviations it can end with
    "We sell pens, ink, paper etc.| The shop opens at 9 a.m.| It closes at 5 p.m. on most days.| The maker is Tessing Inc.| Their rival Halvorn Ltd. went away.",
    "It came from Arno Corp. in the U.S. last year.| She lives in the U.K.| He left the U.S.| They sell cups etc. in all sizes.",
    "Es gibt Hefte, Stifte usw.| Der Laden ist klein.| Es gibt Tassen usw. in allen Größen.| Wir nahmen Seife u.a. mit.| Danach gingen wir.",
    "Там есть ручки, бумага и т.д.| Магазин закрыт.| Чашки и т.п. были дорогими.| Цена 5 руб. за штуку.",
    "Это было в 2019 г.| Потом стало лучше.| В 2020 г. всё изменилось.| Город стоит у г. Казань.| В 1999 гг. было иначе.",
    # numbers, ordinals
    "The price is 25.| The old one was 30.| It holds 4.| that is enough.| We counted 7. of them and kept all.",
    "Am 3. Mai kam der 2. Brief.| Der 1. war verloren.| Es waren 12.| Danach 15.| Im 4. Stock wohnt sie.| Das ist mein 5. Gerät.| Vom 9. bis zum 11. Juni war zu.",
    "Wir zahlten 20.| Sie zahlte 300.| Das reicht.| Jeder 10. Kunde klagt.| Der 7. und letzte kam spät.",
    "Costó 20.| Luego 25.| Tiene 4.| Nada más.| Il coûte 20.| Puis 25.| Rien.| Цена 20.| Потом 25.| Всё.",
    # initials, pronoun, dotted letters
    "J. Halvorn and K. L. Tessing wrote it.| A. Arno read it.| My aunt says so more than I.| The cat knows it too, as do I.| Then we left.",
    "She moved to the U.N. office with B. Linde.| The N.A.T. mode fails.| It runs in D.O.S. only.| We like the S.P.Q.| Then it broke.| Ask T. Okel.",
    "Das sagte J. S. Linde aus dem Haus.| В. Арно и П. П. Линде пришли.| Так сказал А. Окель вчера.",
    # ellipsis
    "I waited… and waited… for nothing.| It broke…| The rest is good...| It was so... and still is.| Hmm… but it works.| So…| Arno left.| Wait...what is it.",
    "Es war... und ist gut.| Es fiel aus…| Dann kam es zurück...| Die Karte fehlt.| Ich warte… und warte.| Mal so…mal so.",
    "Era... y es raro.| Se cayó…| Luego volvió...| La copia falla.| Espero… y espero.| C'était... et reste.| Il tombe…| Puis il revient.",
    "Это было... и осталось.| Упало…| Потом вернулось...| Карта пропала.| Жду… и жду.|这个……不错……|那个也行。|とても……|良い。",
    "It was late, even on an old desk...| pimrusol never fails.| We tried it twice…| zantopel came back...| zantopel again.| It ended…| pimdogaz helped.",
    # marks
    "Really?| Yes!| No?!| Fine!!| why not?| it helps!| 5 stars!| Is it.. no.| What?Then it went.| Good!The end.",
    "¿Funciona?| ¡Sí!| ¿Y ahora?| No lo sé.| Wirklich?| Ja!| warum nicht?| Vraiment ?| Oui !| pourquoi pas ?| Правда?| Да!| почему нет?",
    "See https://example.org/a?b=1 for it!| Is http://example.org/x!y there?| Yes.",
    # quotations and brackets
    "She said \"It works. It is fast.\" and left.| \"Stop. Now!\" he said.| They asked \"Why?\" twice.| Then \"It is over.\"| The end.",
    "\"It works. It is fast.\"| He smiled.| \"Stop!\" she cried.| \"Who knows?\" asked Arno.| “It is good. I like it.”| Nobody moved.| “Go!” they said.",
    "My boss wrote “Buy it. Do not wait.”| We did.| My aunt says “It is fine.” and goes on.| A friend told me \"Try it.\"| zantopel was new then.",
    "(It was late. We left.)| The shop closed.| The shop (it is small. very small.) closed.| We left (at last!).| They came (why?) again.| (See the notes.)| Fine.",
    "Er sagte „Es geht. Gut so.“ und ging.| „Halt!“ rief sie.| Sie schrieb „Kauf es.“| Wir taten es.| (Es war spät. Wir gingen.)| Der Laden war zu.| Das Haus (es ist klein.) steht noch.",
    "Dijo «Funciona. Es rápido.» y se fue.| «¡Alto!» gritó ella.| Escribió «Cómpralo.»| Lo hicimos.| Il dit « Ça marche. C'est bon. » et part.| « Stop ! » cria Arno.| Elle écrit « Achète. »| Nous l'avons fait.",
    "Он сказал «Работает. Быстро.» и ушёл.| «Стой!» крикнула она.| Она писала «Купи.»| Мы купили.| (Было поздно. Мы ушли.)| Магазин закрыт.",
    "她说“可以。很快。”然后走了。|“停！”他说。|他写道：“买吧。”|我们买了。|（很晚了。我们走了。）|店关了。",
    "彼は「動く。速い。」と言った。|「止まれ！」と叫んだ。|「買って。」|私たちは買った。|（遅かった。帰った。）|店は閉まった。|彼女は「良い。」って言う。",
    "同事说：“导出一般。不会再用了！”|出差的时候我带着它。|朋友写道：“很快。”|昨天我买了两个。|老师问：“能用吗？”|大家都笑了。|“能用吗？”朋友问我。|“很慢。”他写道。",
    "友人は言った「遅い。もう使わない！」|先週それを買った。|先生が聞いた「動く？」|みんな笑った。|「動く？」友人が聞いた。|「遅い。」彼は書いた。",
    "كتبت أختي: «القالب ممتاز. لن أعود!»|هذا كل شيء.| سأل صديق: «هل يعمل؟»|نعم يعمل.| كتب أخي: «جيد.»| ثم ذهب.| «هل يعمل؟» سأل صديق.| «جيد جدا!» كتب أخي.",
    "\"आवाज़ अच्छी है।\" मेरी बहन ने लिखा।| \"क्या यह चलता है?\" मित्र ने पूछा।| बहन ने लिखा \"यह अच्छा है।\"| फिर वह गई।| \"धीमा है।\" उसने कहा।| \"ठीक है।\" हमने कहा।| \"नया है!\" भाई ने लिखा।",
    "A client wrote \"It opens. It lasts.\"| 2 of 5 testers agree.| She told us ‘It handles all files.’| 11 of 20 said no.| He wrote \"Never again.\"| gatrurum keeps up.| They said ‘Fine!’| zantopel did too.",
    # points after a bracket, after figures
    "It has not changed (oddly, the layout too).| lutrudofer has.| It failed (and the merge too).| 11 of 20 testers saw it.| La page aussi (et la note).| « Pourquoi pas ? » dit Arno.| It was so (he says). but we went on.| Es ging (fast immer).| Danach nicht.",
    "It writes *.tmp files, cf. fig. 12.| 5 of 14 testers saw it.| See fig. 8.| bimkimar crashes then.| Set the ratio to .15.| hulrupopek works then.| Set it to .14.| 13 of 19 testers did.| We paid 300.| 4 of us left.| It holds 20.| and that is enough.",
    "Elle garde des photos, des notes, etc.| « Pourquoi la fiche ? » demande Arno.| We keep cups, plates, etc.| \"Why?\" asked Arno.| We keep pens, ink etc.| 4 of us left.",
    "It froze on a wet screen.J. K. Arno (a tester) wrote that.| It ended there.B. Linde did too.| Fine.A dog barked.",
    "Это было на столе...| — Это долгий путь.| Он ушёл…| — Да!| Упало.| — Нет.",
    # bracketed sentences between others
    "We paid 20.| (It was late.)| zantopel was there.| \"It works.\"| (A client told us.)| Then we left.| It was so...| (Nobody knows.)| 12 of us left.| (We saw it.)| The shop closed.| Wait…| (It ended.)| Dolpory Mailer is new.",
    # symbols, closing marks, no space
    "It works. 🙂| I like it! 👍👍| Then it broke. 😡| Fine.",
    "很好。我喜欢。|".replace("好。我", "好。|我") + "真的吗？|是的！|太慢了……|不过还行。",
    "良い。|好きだ。|本当？|はい！|遅い……|でも良い。| 다 좋다.| 느리다.| 정말?| 네!",
    "هل يعمل؟| نعم.| لا أعرف!| جيد جدا.| ثم توقف.",
    "यह अच्छा है।| क्या सच में?| हाँ!| धीमा है।",
    # lists, headings, wrapped lines
    "What is good|\n\nIt is fast and\nnever fails.| I use\nit daily.|\n\nWhat is bad|\n\nIt costs\nmuch.",
    "Things I like:|\n- it is fast|\n- it is small. and cheap|\n- it lasts|\n\nThe rest is fine.",
    "Steps:|\n1. open it|\n2. wait|\n3) close it|\nThat was all.",
)

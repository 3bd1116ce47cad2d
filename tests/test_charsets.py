"""Charsets without a mark: sentences that no model was made of, whole and in parts."""

import math

import pytest

from tidegate.functions import charset_models
from tidegate.functions.charset_models import SAMPLES, single_byte
from tidegate.operators.file_jobs import _guess_charset

SENTENCES = {
    "Вчера вечером наша соседка рассказала интересную историю о путешествии через горы. Никто не знал, где находится ключ от этой двери.": ["cp1251", "koi8-r", "cp866", "iso8859-5"],
    "Учора ввечері наша сусідка розповіла цікаву історію про подорож через гори. Ніхто не знав, де знаходиться ключ від цих дверей.": ["cp1251", "koi8-u", "iso8859-5"],
    "Вчера вечерта нашата съседка разказа интересна история за пътуване през планината. Никой не знаеше къде е ключът.": ["cp1251", "koi8-r", "cp866"],
    "Χθες το βράδυ η γειτόνισσά μας διηγήθηκε μια ενδιαφέρουσα ιστορία για ένα ταξίδι στα βουνά. Κανείς δεν ήξερε πού είναι το κλειδί.": ["iso8859-7"],
    "Wczoraj wieczorem nasza sąsiadka opowiedziała ciekawą historię o podróży przez góry. Nikt nie wiedział, gdzie znajduje się klucz do tych drzwi.": ["iso8859-2", "cp1250"],
    "Včera večer nám naše sousedka vyprávěla zajímavý příběh o cestě přes hory. Nikdo nevěděl, kde je klíč od těchto dveří.": ["iso8859-2", "cp1250"],
    "Tegnap este a szomszédunk érdekes történetet mesélt egy hegyeken át vezető útról. Senki sem tudta, hol van az ajtó kulcsa, sőt később sem.": ["iso8859-2", "cp1250"],
    "Dün akşam komşumuz dağlardan geçen bir yolculuk hakkında ilginç bir hikâye anlattı. Kapının anahtarının nerede olduğunu hiç kimse bilmiyordu.": ["iso8859-9"],
    "Hier soir, notre voisine a raconté une histoire intéressante à propos d'un voyage à travers les forêts. Personne ne savait où se trouvait la clé.": ["latin-1"],
    "Gestern Abend erzählte unsere Nachbarin eine schöne Geschichte über eine Reise durch die Wälder. Niemand wusste, wo der Schlüssel für die Tür lag.": ["latin-1"],
    "Ayer por la noche nuestra vecina contó una historia sobre un viaje a través de las montañas. Nadie sabía dónde está la llave, dijo el señor Núñez.": ["latin-1"],
    "昨天晚上我們的鄰居講了一個關於穿越山脈旅行的有趣故事。沒有人知道這扇門的鑰匙在哪裡。": ["big5"],
    "昨天晚上我们的邻居讲了一个关于穿越山脉旅行的有趣故事。没有人知道这扇门的钥匙在哪里。": ["gb18030"],
    "昨日の夜、隣の人が山を越える旅についての面白い話をしてくれました。鍵がどこにあるか誰も知りませんでした。": ["cp932", "euc_jp"],
    "어젯밤에 우리 이웃이 산을 넘는 여행에 대한 재미있는 이야기를 해 주었습니다. 열쇠가 어디에 있는지 아무도 몰랐습니다.": ["euc_kr"],
}


@pytest.mark.parametrize("sentence", SENTENCES)
def test_sentences(sentence):
    assert not any(sentence in text for texts in SAMPLES.values() for text in texts)
    for charset in SENTENCES[sentence]:
        for text in (sentence, f"id;name\n1;{sentence}\n" * 3, sentence.upper()):
            raw = text.encode(charset, "ignore")
            assert raw.decode(_guess_charset(raw)) == raw.decode(charset), charset


def recall(words):
    """The share of parts of so many words that are decoded as they were encoded."""
    right = total = 0
    for sentence, charsets in SENTENCES.items():
        parts = sentence.split(" ")
        for charset in charsets if len(parts) > 1 else []:
            for at in range(len(parts) - words + 1):
                raw = " ".join(parts[at : at + words]).encode(charset, "ignore")
                if not raw.isascii():
                    total += 1
                    right += raw.decode(_guess_charset(raw)) == raw.decode(charset)
    return right / total


@pytest.mark.parametrize("words, least", [(2, 0.8), (4, 0.9), (8, 0.97), (12, 0.99)])
def test_recall_of_short_texts(words, least):
    found = recall(words)
    print(words, round(found, 3))
    assert found >= least


def test_other_bytes():
    assert single_byte(b"") == ("latin-1", False)
    assert _guess_charset(bytes(range(128, 256))) in ("latin-1", "cp866", "koi8-u", "cp1251")
    assert _guess_charset("It’s “déjà vu” – 5 €".encode("cp1252")) == "cp1252"
    assert _guess_charset("naïve café".encode("latin-1")) == "latin-1"
    long = "plain words " * 20_000 + "Она пришла домой"
    assert _guess_charset(long.encode("koi8-r")) == "koi8-r"
    late = "Она пришла домой и увидела, что никого нет. " * 3000
    assert _guess_charset(late.encode("cp1251") + b"\x98") != "cp1251"  # does not decode every byte


def test_pairs_are_scored_once(monkeypatch):
    text = "Вчера вечером наша соседка рассказала интересную историю о путешествии через горы."
    contents = [f"{i}; {text} {text[i % 60 :]}".encode(charset) for i in range(60) for charset in ("koi8-r", "cp1251")]
    expected = [single_byte(content) for content in contents]
    assert expected == [("koi8-r", True), ("cp1251", True)] * 60
    scored, score = [], charset_models.Model.score
    monkeypatch.setattr(charset_models.Model, "score", lambda self, *pair: scored.append(pair) or score(self, *pair))
    assert [single_byte(content) for content in contents] == expected
    assert len(scored) < 1000


def test_sums_of_words_are_those_of_the_text():
    for texts in charset_models.SAMPLES.values():
        for charset, name in charset_models.CHARSETS:
            content = " ".join(texts).encode(charset, "ignore")
            words = charset_models.excerpt(content)
            at = charset_models.CHARSETS.index((charset, name))
            total, number = sum(charset_models.word_readings(word)[:, at] for word in words) if words else (0, 0)
            plain = charset_models.reading(b" ".join(words).decode(charset), name)
            assert number == plain[1] and math.isclose(total, plain[0], rel_tol=1e-12, abs_tol=1e-12)

"""Models of how letters follow each other, to tell single-byte charsets apart.

In a single-byte charset any bytes are a text, so a charset is judged by what the text would say. A
model of a script has the probabilities of letters behind letters in sample sentences of its languages,
and of unusual cases, such as capitals within words. Content is read in every charset; the words with
bytes above 0x7F are scored by the model of the charset's languages.
"""

import math
import re
from collections import Counter
from functools import cache, lru_cache

import numpy as np

# Sample sentences, all of everyday words; the models hold no more than pairs of letters of them.
SAMPLES = {
    "cyrillic": (
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и"
        " должны поступать в отношении друг друга в духе братства. Сегодня утром в городе было холодно, и мы пошли"
        " домой через старый парк, где дети играли на снегу. Завтра я хочу купить хлеб, молоко, яйца и рыбу, потому"
        " что вечером приедут наши друзья из Москвы. Этот вопрос ещё обсуждается, но ответ может быть получен уже"
        " на следующей неделе. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность."
        " Цена товара указана в рублях; доставка осуществляется в течение трёх рабочих дней после оплаты счёта.",
        "Усі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і"
        " повинні діяти у відношенні один до одного в дусі братерства. Сьогодні ввечері ми поїдемо до міста, щоб"
        " купити їжу та зустріти наших друзів, які щойно приїхали з Києва.",
        "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да"
        " се отнасят помежду си в дух на братство. Утре ще отидем на пазара, за да купим хляб и мляко.",
    ),
    "greek": (
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με"
        " λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Σήμερα το πρωί"
        " έκανε κρύο στην πόλη και γυρίσαμε στο σπίτι από το παλιό πάρκο, όπου έπαιζαν τα παιδιά. Αύριο θέλω να"
        " αγοράσω ψωμί, γάλα, αυγά και ψάρι, επειδή το βράδυ θα έρθουν οι φίλοι μας από την Αθήνα. Κάθε άνθρωπος"
        " έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική ασφάλεια.",
    ),
    "central": (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i"
        " sumieniem i powinni postępować wobec innych w duchu braterstwa. Dziś rano było zimno w mieście, więc"
        " poszliśmy do domu przez stary park, gdzie bawiły się dzieci. Jutro chcę kupić chleb, mleko, jajka i rybę,"
        " ponieważ wieczorem przyjadą nasi przyjaciele z Łodzi. Każdy człowiek ma prawo do życia, wolności i"
        " bezpieczeństwa swojej osoby. Źródło jest później, a może też żółte, ćwierć i sześć.",
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají"
        " spolu jednat v duchu bratrství. Dnes ráno bylo ve městě chladno a šli jsme domů přes starý park, kde si"
        " hrály děti. Zítra chci koupit chléb, mléko, vejce a ryby, protože večer přijedou naši přátelé z Plzně."
        " Žádný člověk není příliš těžký, když ještě něco může říci.",
    ),
    "hungarian": (
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel"
        " bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Ma reggel hideg volt a városban,"
        " ezért a régi parkon át mentünk haza, ahol gyerekek játszottak. Holnap kenyeret, tejet, tojást és halat"
        " szeretnék venni, mert este megérkeznek a barátaink Győrből. Később egy erdőben főztünk, és a fűben ültünk."
        " Az idő szép volt, a gyerekek örültek, és mindenki jókedvűen énekelt. Kérem, írja le, hogyan jutott el"
        " idáig, és mit látott útközben. A könyvet, amelyet tegnap kértél, végül megtaláltam az asztalon, a levelek"
        " között. Több embernek segíteni kellene, mert nehéz időket élünk, és ők is értünk dolgoznak. Először"
        " megnéztük a régi várat, utána lementünk a tóhoz úszni, és késő éjszaka értünk vissza a szállásra.",
    ),
    "turkish": (
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine"
        " karşı kardeşlik zihniyeti ile hareket etmelidirler. Bu sabah şehirde hava soğuktu ve çocukların oynadığı"
        " eski parkın içinden eve gittik. Yarın ekmek, süt, yumurta ve balık almak istiyorum, çünkü akşam"
        " İstanbul'dan arkadaşlarımız gelecek. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Değişik"
        " ağaçlar, küçük taşlar ve ılık güneş ışığı.",
    ),
    "western": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de"
        " conscience et doivent agir les uns envers les autres dans un esprit de fraternité. L'été à Genève, où déjà"
        " tout est prêt, la forêt, l'hôtel et le garçon français. Après le dîner, ma sœur a reçu une lettre très"
        " intéressante. C’était déjà décidé : le prix sera fixé à la réunion.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt"
        " und sollen einander im Geist der Brüderlichkeit begegnen. Heute früh war es kühl, und wir gingen über die"
        " alte Brücke nach Hause. Möchten Sie für die Mädchen größere Schlüssel, schöne Äpfel und süße Öle kaufen?",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y"
        " conciencia, deben comportarse fraternalmente los unos con los otros. Mañana el niño comerá más jamón"
        " aquí, según dijo la señora. ¿Dónde está el camión? La corazón, también así después, qué será.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. São dotados de razão e de"
        " consciência e devem agir uns para com os outros em espírito de fraternidade. Amanhã não há avião; às três"
        " horas, você virá à estação. Ações, informações, opiniões, português e inglês.",
        "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och"
        " bör handla gentemot varandra i en anda av broderskap. På våren går många små båtar över sjön. Å, så"
        " härligt. Alle mennesker er født frie og med samme menneskeverd; på øya får bøndene gjøre det de må."
        " Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, ja heidän on toimittava"
        " toisiaan kohtaan veljeyden hengessä. Tänään sää on kylmä; lähdemme pian kävelylle järven äärelle.",
    ),
}

#: Charsets and models of what may be written in them; of charsets that read some bytes alike the first one is named.
CHARSETS = (
    ("cp1251", "cyrillic"), ("koi8-r", "cyrillic"), ("koi8-u", "cyrillic"), ("cp866", "cyrillic"),
    ("iso8859-5", "cyrillic"), ("iso8859-7", "greek"), ("cp1253", "greek"), ("iso8859-2", "central"),
    ("cp1250", "central"), ("iso8859-2", "hungarian"), ("cp1250", "hungarian"), ("iso8859-9", "turkish"),
)
#: The charsets of western letters.
WESTERN = ("latin-1", "cp1252")
#: Characters that are among the most frequent ones of Chinese texts, in simplified and traditional writing.
COMMON = {
    "gb18030": "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长",
    "big5": "的一是不了人我在有他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後小麼心多天而能好都然沒日於起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三已老從動兩長",
}

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|[^\x00-\x7f\s]+")
_EDGE = " "


def _pairs(word: str):
    """Neighbouring symbols: letters in lower case, and how the case changes."""
    before, case = _EDGE, "^"
    for c in word:
        low = c.lower()
        own = "u" if c != low else "l"
        yield before, low, "" if case in ("^", own) or (case, own) == ("u", "l") else "!"
        before, case = low, own
    yield before, _EDGE, ""


class Model:
    """Pairs of letters of some languages, smoothed by how frequent the letters are."""

    def __init__(self, samples: tuple[str, ...]):
        pairs, single = Counter(), Counter()
        for text in samples:
            for word in _WORD.findall(text):
                for a, b, _ in _pairs(word):
                    pairs[a, b] += 1
                    single[b] += 1
        self.pairs, self.single, self.total = pairs, single, sum(single.values())
        self.behind = Counter()
        for (a, _), n in pairs.items():
            self.behind[a] += n

    def score(self, a: str, b: str, odd: str) -> float:
        letter = self.single.get(b, 0) / self.total or 3e-5
        chance = (self.pairs.get((a, b), 0) + 4 * letter) / (self.behind.get(a, 0) + 4)
        # Letters of two scripts, and odd cases, do not meet in a word.
        return math.log(chance) - (3.0 if odd or a not in self.behind else 0.0)


@cache
def model(name: str) -> Model:
    return Model(SAMPLES[name])


@lru_cache(1 << 16)
def _step(name: str, a: str, b: str, odd: str) -> float:
    return model(name).score(a, b, odd)


def reading(text: str, name: str) -> tuple[float, int]:
    """The log probabilities of the pairs with a character above U+007F, added up, and how many there are."""
    total, number = 0.0, 0
    for word in _WORD.findall(text):
        if word.isascii():
            continue
        for a, b, odd in _pairs(word):
            if a > "\x7f" or b > "\x7f":
                total += _step(name, a, b, odd)
                number += 1
    return total, number


#: A reading has to be at least this good, and this much better than the western one.
GOOD, MARGIN = -5.1, 0.4
#: Bytes of words with bytes above 0x7F that a charset is judged by; it has to decode all others as well.
EXCERPT = 60_000
_C1 = re.compile(rb"[\x80-\x9f]")
_ODD_WORD = re.compile(rb"[A-Za-z'\x80-\xff-]*[\x80-\xff][A-Za-z'\x80-\xff-]*")


#: Readings of words of at most so many bytes are kept, of so many words.
KEPT_BYTES, KEPT_WORDS = 48, 1 << 15


def excerpt(raw: bytes) -> list[bytes]:
    """The first words with bytes above 0x7F."""
    words, size = [], 0
    for word in _ODD_WORD.finditer(raw):
        words.append(word.group()[:EXCERPT])
        size += len(words[-1])
        if size > EXCERPT:
            break
    return words


def word_readings(word: bytes) -> np.ndarray:
    """Two rows: the sums and the numbers of the readings in CHARSETS, then in WESTERN; NaN where it does not decode."""
    found = []
    for charset, name in CHARSETS + tuple((charset, "western") for charset in WESTERN):
        try:
            found.append(reading(word.decode(charset), name))
        except UnicodeDecodeError:
            found.append((math.nan, math.nan))
    return np.array(found).T


@lru_cache(KEPT_WORDS)
def _kept_readings(word: bytes) -> np.ndarray:
    return word_readings(word)


def decodes(raw: bytes, charset: str) -> bool:
    try:
        raw.decode(charset)
        return True
    except UnicodeDecodeError:
        return False


def single_byte(raw: bytes) -> tuple[str, bool]:
    """The single-byte charset in which the content reads best, and whether it reads well.

    Without a good reading it is latin-1, or cp1252 if the bytes from 0x80 to 0x9F are its punctuation.
    """
    words, found = excerpt(raw), []
    readings = np.zeros((2, len(CHARSETS) + len(WESTERN)))
    for word in words:
        readings += _kept_readings(word) if len(word) <= KEPT_BYTES else word_readings(word)
    sums, numbers = readings.tolist()
    means = [total / number if number else 0.0 for total, number in zip(sums, numbers)]
    for place, (charset, _) in enumerate(CHARSETS):
        if numbers[place] > 0:
            found.append((round(-means[place], 9), place, charset))
    western = "latin-1"
    if any(_C1.search(word) for word in words) and decodes(raw, "cp1252"):
        western = "cp1252"
    at = len(CHARSETS) + WESTERN.index(western)
    own, number = means[at], numbers[at]
    for cost, _, charset in sorted(found):
        if -cost < GOOD or -cost < own + MARGIN:
            break
        if decodes(raw, charset):
            return charset, True
    return western, bool(number) and own >= GOOD


def common_share(text: str, charset: str) -> float:
    """The share of frequent Chinese characters among those above U+007F."""
    odd = [c for c in text if c > "\x7f"]
    return sum(c in COMMON[charset] for c in odd) / len(odd) if odd else 0.0

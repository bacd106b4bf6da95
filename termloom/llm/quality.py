"""Per-document text statistics and the nearest structural profile by Jensen-Shannon divergence (problem 8)."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.encode import blocks
from termloom.runtime import spread

# Common words of four languages by their part in a sentence. 'clause' words stand in running sentences; 'phrase' words
# also join the words of headings, list entries and cells.
CLAUSE = {
    "en": "i he she it we they you him them us me my his her its our their this these those that who whom whose what how why is was were are be been being am has had have having do does did would could should may might must can cannot will shall said says say says not never nor nothing and but or if than then there because although though while since so however both either no none only later too also even most more whether",
    "fr": "je j il elle on nous vous ils elles qu que qui quoi dont où ce cela cette ces son sa ses leur leurs notre votre est sont était étaient été être ont avait avaient avoir aurait fut soit n ne pas jamais rien aucun aucune et ou mais car si donc puis toutefois lorsqu puisque parce bien afin dit mieux encore plus pourquoi comment y se s même selon entre personne",
    "de": "ich er sie es wir ihr ihm ihn uns mir mich sich dies dieser diese dieses wer was wie warum ist war waren sind sei wäre sein hat hatte haben hatten wird wurde werden wurden kann konnte soll sollte muss nie niemals nichts kein keine keiner und aber oder denn ob dass wenn weil obwohl damit doch noch nur erst auch dabei davon darin dennoch außerdem sofern unserer unsere seiner ihrer niemand besser als so geht",
    "es": "yo él ella ello nosotros ellos usted me nos se lo le les su sus nuestro nuestra este esta esto ese esa eso que quien cual cuyo qué cómo porqué es era eran son fue fueron ser sido ha han había habían haber sería hay no nunca nadie nada ni y e o u pero sino si aunque mientras además también sólo solo más según como aún todavía pues ya",
}
PHRASE = {
    "en": "the a an of in on at to for from by with without within before after during under over between into about as long when",
    "fr": "le la les l un une des du de d à au aux en dans par pour sur sans avant après pendant lorsque chez vers a",
    "de": "der die das den dem des ein eine einen einem einer eines im in am an zu zum zur von vom mit ohne bei nach vor aus auf für um durch innerhalb während bis über unter nicht",
    "es": "el la los las un una unos unas de del al a en con sin por para antes después durante desde hasta entre sobre cuando",
}
ARTICLES = {"en": "the a an", "fr": "le la les l un une", "de": "der die das den dem des ein eine einen einem einer eines", "es": "el la los las un una unos unas"}
LANGUAGES = tuple(CLAUSE)

# Example texts of our own, from which the profiles are computed by the code that also measures documents: prose of each language, entries of lists in each, and the
# other structures.
PROSE = {
    "en": (
        "The tenant told us that she had never received the letter, although the clerk was sure that it had been sent in May. We asked the bank for a copy of the statement, but "
        "no one could say where it was kept. If the buyer agrees, the parties will meet again before the end of the month to settle what is left of the claim. It was the surveyor "
        "who first saw the crack in the wall. He wrote to the owner, and she answered that she would look into it. Nothing in the lease says that the rent may be raised without "
        "notice. Why did the driver not stop after the accident? The matter concerns a loan of 20,000 dollars, which our client gave to his brother in the spring of 2011. "
        "According to the witness, the meeting ended at noon. See section 4 of the deed, which says that the land must not be sold. I do not know whether they were paid, and I "
        "have not been able to find out. The sum of 3,500 was to be paid on the first day of the year, but the company kept a part of it. \"That is not what I signed,\" he said, "
        "and then he left. This report does not deal with the second invoice. The judge read the file, and the lawyer for the insurer asked for more time. The bank sent a map of "
        "the land to the clerk on the third day of the week. Bell and Miller Ltd had worked together for 12 years. Miller expects 40 more pages on the water rights, most of them "
        "from Harbour Foods. In our view this is a question of tax law rather than of contract, while the trial is still open. According to Ann Bell, the owner signed the second "
        "contract before the closing. The engineer repaired the roof without permission, and the tenant paid the bill within 30 days. The fee of 900 covers the winter report but "
        "not the copies that the agent asked for. Rivers and Lamp Trust disputed the sale."
    ),
    "fr": (
        "La locataire nous a dit qu'elle n'avait jamais reçu la lettre, bien que le greffier soit certain qu'elle avait été envoyée en mai. Nous avons demandé à la banque une "
        "copie du relevé, mais personne ne savait où il était conservé. Si l'acheteur accepte, les parties se réuniront avant la fin du mois pour régler ce qui reste de la "
        "demande. C'est le géomètre qui a vu le premier la fissure dans le mur. Il a écrit au propriétaire, et celui-ci a répondu qu'il s'en occuperait. Rien dans le bail ne dit "
        "que le loyer peut être augmenté sans préavis. Pourquoi le conducteur ne s'est-il pas arrêté après l'accident ? L'affaire porte sur un prêt de 20 000 euros que notre "
        "client a consenti à son frère au printemps 2011. Selon le témoin, la réunion s'est terminée à midi. Voir l'article 4 de l'acte, selon lequel le terrain ne doit pas être "
        "vendu. Je ne sais pas s'ils ont été payés, et je n'ai pas pu le vérifier. La somme de 3 500 euros devait être versée le premier jour de l'année, mais la société en a "
        "gardé une partie. « Ce n'est pas ce que j'ai signé », a-t-il dit. Le juge a lu le dossier, et l'avocat de l'assureur a demandé un délai. La banque a envoyé un plan du "
        "terrain au greffier le troisième jour de la semaine. Bell et la société Miller avaient travaillé ensemble pendant 12 ans. Miller attend encore 40 pages, dont la plupart "
        "viennent de Harbour Foods. À notre avis, c'est une question de droit fiscal plutôt que de contrat, alors que le procès est en cours. Selon Anne Bell, le propriétaire a "
        "signé le second contrat avant la vente. L'ingénieur a réparé le toit sans autorisation, et la locataire a payé la facture dans un délai de 30 jours. Les frais de 900 "
        "euros couvrent le rapport mais pas les copies. La question de Water Rights reste ouverte."
    ),
    "de": (
        "Die Mieterin sagte uns, dass sie den Brief nie erhalten hat, obwohl der Schreiber sicher war, dass er im Mai verschickt wurde. Wir haben die Bank um eine Abschrift "
        "gebeten, aber niemand wusste, wo sie liegt. Wenn der Käufer zustimmt, treffen sich die Parteien vor dem Ende des Monats, um den Rest der Forderung zu regeln. Es war der "
        "Gutachter, der den Riss in der Wand zuerst sah. Er schrieb an den Eigentümer, und dieser antwortete, dass er sich darum kümmern werde. Nichts in dem Vertrag besagt, dass "
        "die Miete ohne Nachricht erhöht werden kann. Warum hat der Fahrer nach dem Unfall nicht gehalten? Es geht um ein Darlehen von 20.000 Euro, das unser Mandant seinem "
        "Bruder im Frühjahr 2011 gab. Nach Angaben der Zeugin endete die Sitzung am Mittag. Siehe Abschnitt 4 der Urkunde, wonach das Land nicht verkauft werden soll. Ich weiß "
        "nicht, ob sie bezahlt wurden, und ich konnte es auch nicht feststellen. Der Betrag von 3.500 Euro sollte am ersten Tag des Jahres gezahlt werden, doch die Firma behielt "
        "einen Teil davon. „Das habe ich nicht unterschrieben“, sagte er. Der Richter las die Akte, und der Anwalt der Versicherung bat um eine Frist. Die Bank schickte am "
        "dritten Tag der Woche einen Plan des Landes an den Schreiber. Bell und die Firma Miller hatten 12 Jahre lang zusammen gearbeitet. Miller erwartet noch 40 Seiten, die "
        "meisten davon von Harbour Foods. Unserer Ansicht nach ist das eine Frage des Steuerrechts, während der Prozess noch lief. Nach Angaben von Anna Bell unterschrieb der "
        "Eigentümer den zweiten Vertrag vor dem Verkauf. Der Bauleiter reparierte das Dach ohne Erlaubnis, und die Mieterin zahlte die Rechnung innerhalb von 30 Tagen. Die Kosten "
        "von 900 Euro decken den Bericht, nicht aber die Kopien. Ich traf Miller in der Stadt, und wir gingen die Liste durch."
    ),
    "es": (
        "La inquilina nos dijo que nunca había recibido la carta, aunque el secretario estaba seguro de que se envió en mayo. Pedimos al banco una copia del extracto, pero nadie "
        "sabía dónde se guardaba. Si el comprador acepta, las partes se reunirán antes del fin de mes para arreglar lo que queda de la demanda. Fue el perito quien vio primero la "
        "grieta en la pared. Escribió al dueño, y este contestó que se ocuparía de ello. Nada en el contrato dice que la renta pueda subir sin aviso. ¿Por qué el conductor no "
        "paró después del accidente? El asunto trata de un préstamo de 20.000 euros que nuestro cliente dio a su hermano en la primavera de 2011. Según la testigo, la reunión "
        "terminó a mediodía. Véase el artículo 4 de la escritura, según el cual la tierra no se debe vender. No sé si les pagaron, y tampoco lo he podido averiguar. La suma de "
        "3.500 euros debía pagarse el primer día del año, pero la empresa se quedó con una parte. «Eso no es lo que firmé», dijo, y luego se fue de la sala. El juez leyó el "
        "expediente, y el abogado de la aseguradora pidió más tiempo. El banco envió un plano del terreno al secretario el tercer día de la semana. Bell y la empresa Miller "
        "habían trabajado juntos durante 12 años. Miller espera otras 40 páginas, la mayoría de Harbour Foods. A nuestro juicio es una cuestión de impuestos y no de contratos, "
        "mientras el juicio sigue abierto. Según Ana Bell, el dueño firmó el segundo contrato antes de la venta. El ingeniero reparó el tejado sin permiso, y la inquilina pagó la "
        "factura en un plazo de 30 días. Los gastos de 900 euros cubren el informe pero no las copias. La cuestión de Water Rights queda en espera."
    ),
}
ENTRIES = {
    "en": (
        "the letter to the bank\na copy of the lease\nthe second page before the hearing\nthe owner, Miller\nan open bill after the end of the year, 14, 27\nthe map of the land in the "
        "spring of 2011\nan unpaid bill within 30 days;\nthe report at the request of Bell, Miller.\nthe deed; the map of the land, Bell; a list without date; the bill / the lease "
        "before the sale / an old page, Lamp"
    ),
    "fr": (
        "la lettre à la banque\nune copie du bail\nla deuxième page avant la fin du mois\nle contrat de vente, Miller\nla facture après la vente, 14, 27\nle plan du terrain au "
        "printemps 2011\nla facture dans un délai de 30 jours;\nle rapport à la demande de Bell, Miller.\nl'acte; le plan du terrain, Bell; une liste sans date; la facture / le bail "
        "avant la vente / l'ancienne page, Lamp"
    ),
    "de": (
        "den Brief an die Bank\neine Abschrift des Vertrags\ndie zweite Seite vor dem Ende der Frist\nder Eigentümer, Miller\ndie offene Rechnung nach dem Verkauf, 14, 27\nden Plan im "
        "Frühjahr 2011\ndie Liste innerhalb von 30 Tagen;\ndas Gutachten auf Bitten von Bell, Miller.\ndie Urkunde; den Plan des Landes, Bell; die Liste ohne Datum; das Schreiben / "
        "den Vertrag vor dem Verkauf / die alte Seite, Lamp"
    ),
    "es": (
        "la carta al banco\nuna copia del contrato\nla segunda página antes del fin de mes\nel dueño, Miller\nla factura después de la venta, 14, 27\nel plano de la casa en la "
        "primavera de 2011\nla lista en un plazo de 30 días;\nel informe a petición de Bell, Miller.\nla escritura; el plano del terreno, Bell; una lista sin fecha; la factura / el "
        "contrato antes de la venta / la página vieja, Lamp"
    ),
}
OTHERS = {
    "list of names": (
        "Roof Repair Contracts\nJohn Miller, Ann Bell\nharbour fees\nAnnex 12\n[ ] Water rights, 14, 27, 103\nSale of Timber;\nTravel Claims.\nLamp, Chair\nWinter School Reports\n(b) "
        "Annex 7;\nBarley, 220"
    ),
    "columns": (
        "Day             Name          City        Sum\n2011-04-03      Miller        Leeds       120.50\n2011-04-09      Bell          before the sale   88.00\n2012-10-30\tWater "
        "rights\tYork\topen\n2013-01-17      if the bank agrees      Hull        7310.25"
    ),
    "cells": (
        "<table><tr><td>Day</td><td>Name</td><td>Sum</td></tr><tr><td>2011-04-03</td><td>Miller</td><td>120.50</td></tr></table>\n| Day | Name | Sum |\n|---|---|---|\n| 2011-04-03 | "
        "Miller | 120.50 |\n| 2012-10-30 | the sale of the land | 88.00 |\nHome | Help | Search | Next > | < Back | Contact | Print"
    ),
    "quoted cells": (
        "\"Day\",\"Name\",\"Sum\"\n\"2011-04-03\",\"Miller\",\"120.50\"\n\"2012-10-30\",\"because the bill was open\",\"88.00\"\n2011-04-09;Bell;after the sale;7\n2013-01-17;Lamp;si el banco lo "
        "acepta;310\n2013-02-11;Bell;el contrato de la casa;40\n2013-02-12;Miller;porque no era clara;7\n2013-01-18;Chair;wenn die Bank zustimmt;9\n2013-01-18;Chair;bien que la "
        "lettre soit perdue;12"
    ),
    "fields": (
        "Day: 2011-04-03\nName: Miller\nSum: 120.50\nState: open\nPlace: \nReason: before the end of the year\nNo.: 4412"
    ),
    "symbols": (
        "##########----------==========\n**************........____\n7 19 3345 0 21 88 904 5 61 2 40127 33\n%$#@ {}[] ~~ ^^ || && <> ++ // \\\\ ;;\n□■�●▲▒░"
    ),
    "codes": (
        "2011-04-03T10:22:31 ERROR [net-7] code=502 id=9f3a-77c1 path=/a/b/c.txt\n10.0.0.17 - GET /x?id=44&k=9 200 1532\nfunction f(x) { return x + 1; }\nA7-3391-XK, QT/20.4/81, "
        "0x7fa3bc, user_12@host.example"
    ),
}

#: The family of structures that each profile counts for.
FAMILY = {"prose": "prose", "entries": "list", "list of names": "list", "columns": "table", "cells": "table", "quoted cells": "table", "fields": "table", "symbols": "noise", "codes": "noise", "letters": "noise", "salad": "noise"}

#: Kinds of tokens: other words, words of a clause, prepositions and the like, articles, numbers, sentence marks; 6 is the edge of a line, 7 is left out.
OTHER, MAIN, JOINT, ARTICLE, NUMBER, MARK, EDGE, SKIP = range(8)
#: Weight of the divergence of characters beside that of words; of a line's own divergence beside that of its paragraph; share of even noise in a profile; so near to the
#: nearest profile prose is prose.
CHARACTERS, OWN, SMOOTHING, MARGIN = 0.5, 0.5, 0.01, 0.05


class _Kinds(dict):
    """Kind of each lower-case token in one language."""

    def __init__(self, language: str):
        articles = set(ARTICLES[language].split())
        super().__init__({**{w: ARTICLE if w in articles else JOINT for w in PHRASE[language].split()}, **{w: MAIN for w in CLAUSE[language].split()}})
        self.common = {w: k for w, k in self.items()}

    def __missing__(self, token: str) -> int:
        kind = OTHER if token[0].isalpha() else NUMBER if token[0].isdigit() or token[0] == "_" else MARK if token in _MARKS else SKIP
        if len(self) < 200_000:
            self[token] = kind
        return kind


#: Character classes: lower case, upper case, digits, blanks, line ends, sentence marks, other punctuation, the rest.
CLASSES = ("lower", "upper", "digit", "blank", "line", "mark", "punctuation", "other")


def _class_table() -> np.ndarray:
    out = np.full(65536, 7, np.uint8)
    for i in range(65536):
        ch = chr(i)
        if ch in "\n\r\x0b\x0c\x85\u2028\u2029":
            out[i] = 4
        elif ch.isspace():
            out[i] = 3
        elif ch.isdigit():
            out[i] = 2
        elif ch.isalpha():
            out[i] = 1 if ch.isupper() else 0
        elif ch in ".,;:?!'\"()’“”«»„¿¡…–—-":
            out[i] = 5
        elif i < 0x2600 and not (0xD800 <= i < 0xE000) and ch.isprintable():
            out[i] = 6
    return out


_TABLE = _class_table()

_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARKER = re.compile(r"^\s*(?:[-*•–—·>▪◦‣#+o]\s+|\[[ xX]\]\s*|\(?(?:\d{1,4}(?:\.\d{1,4})*|[A-Za-z]|[ivxlcIVXLC]{1,6})\s?[.):]\s+|§+\s*\d+[^\s]*\s*|\d{1,4}\s{1,4}(?=\S))")
_SENTENCE = re.compile(r"[.!?…。][\"'”’»)\]“]*\s+(?=[\"'“‘«„(\[¿¡—–-]*\w)")
_MARKS = frozenset(".!?…。")
_CLOSERS = " \t\"'”’»“)]"
_TOKEN = re.compile(r"[^\W\d_]+|[\d_]+(?:[.,:/-]\d+)*|[^\s\w]")
_GAP = re.compile(r"[ \u00a0\u2002-\u200a\u202f\u3000]{2,}|\t")

KINDS = {g: _Kinds(g) for g in LANGUAGES}
_COMMON: dict[str, list[int]] = {}
for _at, _g in enumerate(LANGUAGES):
    for _w in KINDS[_g].common:
        _COMMON.setdefault(_w, []).append(_at)


def divergence(p, q) -> float:
    """Jensen-Shannon divergence of two distributions in bits: 0 for equal ones, 1 for those with nothing in common. Weights need not sum to 1."""
    return float(divergences(np.array([p], float), np.array([q], float))[0, 0])


def divergences(counts: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Divergence of each row of ``counts`` from each row of ``profiles``."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    q = profiles / profiles.sum(axis=1, keepdims=True)
    plogp = lambda x: np.einsum("...i,...i->...", x, np.log2(np.maximum(x, 1e-300)))
    out = np.empty((len(p), len(q)))
    for k, row in enumerate(q):
        out[:, k] = -plogp((p + row) / 2)
    return np.maximum(out + (plogp(p)[:, None] + plogp(q)[None, :]) / 2, 0.0)


def _ended(line: str) -> bool:
    """Whether a line or unit ends as a sentence does, quotation marks and brackets aside."""
    return line.rstrip(_CLOSERS)[-1:] in _MARKS


def _unwrap(lines: list[str], ended: list[bool]) -> Iterator[tuple[str, bool]]:
    """The lines of a paragraph, with running text that was broken at a width joined again: a line that doesn't end as a sentence does
    and after which the next line's first word wouldn't have fitted."""
    if len(lines) == 1:
        yield lines[0], ended[0]
        return
    wide = max(map(len, lines[:-1]))
    held, done = [lines[0]], ended[0]
    for a, b, end in zip(lines, lines[1:], ended[1:]):
        if not done and wide >= 30 and len(a) + len(b.partition(" ")[0]) >= wide - 1 and not b[0].isspace() and "\t" not in b and "|" not in b and not _MARKER.match(b):
            held.append(b)
        else:
            yield " ".join(held), done
            held = [b]
        done = end
    yield " ".join(held), done


def _transitions(kinds: list[list[int]]) -> np.ndarray:
    """For each line the counts of the pairs of neighbouring kinds of tokens, with its edges."""
    flat: list[int] = []
    for line in kinds:
        flat.append(EDGE)
        flat.extend(line)
    flat.append(EDGE)
    a = np.array(flat, np.int64)
    a = a[a != SKIP]
    line = np.cumsum(a == EDGE)[:-1] - 1
    return np.bincount(line * 49 + a[:-1] * 7 + a[1:], minlength=49 * len(kinds)).reshape(-1, 49)


def _characters(lines: list[str]) -> np.ndarray:
    """For each line the counts of letters, digits, sentence marks, other punctuation, the rest, blanks in runs, and single blanks."""
    codes = np.frombuffer("\n".join(lines).encode("utf-16-le", "surrogatepass"), np.uint16)
    classes = np.bincount(np.cumsum(codes == 10) * 8 + _TABLE[codes], minlength=8 * len(lines)).reshape(-1, 8)[: len(lines)]
    gaps = np.array([sum(map(len, _GAP.findall(x.strip()))) if "  " in x or "\t" in x or not x.isascii() else 0 for x in lines], np.int64)
    return np.stack([classes[:, 0] + classes[:, 1], classes[:, 2], classes[:, 5], classes[:, 6], classes[:, 7], gaps, np.maximum(classes[:, 3] - gaps, 0)], axis=1)


def _bodies(lines: list[str]) -> list[str]:
    """Lines without the mark of a list entry."""
    return [x[m.end() :] if (m := _MARKER.match(x)) else x for x in lines]


def _profiles() -> tuple[list[str], list[str | None], np.ndarray, np.ndarray]:
    """Names, languages, token transitions and characters of all profiles. Words in no order are those of a language's prose drawn one by one; letters in no order are random."""
    names: list[str] = []
    languages: list[str | None] = []
    words: list[np.ndarray] = []
    chars: list[np.ndarray] = []

    def add(name: str, language: str | None, text: str) -> None:
        lines = text.split("\n")
        tokens = [_TOKEN.findall(b.lower()) for b in _bodies(lines)]
        kinds = [[KINDS[language or _language(Counter(line))][t] for t in line] for line in tokens]
        names.append(name)
        languages.append(language)
        words.append(_transitions(kinds).sum(axis=0).astype(float))
        chars.append(_characters(lines).sum(axis=0).astype(float))

    for g in LANGUAGES:
        add("prose", g, PROSE[g])
    for g in LANGUAGES:
        add("entries", g, ENTRIES[g])
    for at, g in enumerate(LANGUAGES):
        kinds = words[at].reshape(7, 7)[:, :MARK].sum(axis=0)
        drawn = np.zeros((7, 7))
        drawn[:MARK, :MARK] = np.outer(kinds, kinds)
        names.append("salad")
        languages.append(g)
        words.append(drawn.ravel())
        chars.append(chars[at] * np.array([1, 1, 0.3, 1, 1, 1, 1]))
    for name, text in OTHERS.items():
        add(name, None, text)
    rng = random.Random(5)
    add("letters", None, " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 10))) for _ in range(400)))
    even = lambda rows: np.stack([r / r.sum() * (1 - SMOOTHING) + SMOOTHING / len(r) for r in rows])
    return names, languages, even(words), even(chars)


def _language(counts: Counter) -> str:
    """The language whose common words cover most tokens."""
    covered = [0] * len(LANGUAGES)
    for w in _COMMON.keys() & counts.keys():
        for at in _COMMON[w]:
            covered[at] += counts[w]
    return LANGUAGES[max(range(len(LANGUAGES)), key=covered.__getitem__)]


NAMES, OF_LANGUAGE, WORD_PROFILES, CHARACTER_PROFILES = _profiles()
_IS_PROSE = np.array([n == "prose" for n in NAMES])
_ALLOWED = {g: np.array([x is None or x == g for x in OF_LANGUAGE]) for g in LANGUAGES}
_FAMILIES = ("prose", "list", "table", "noise")
_FAMILY_OF = np.array([_FAMILIES.index(FAMILY[n]) for n in NAMES])


def _distance(words: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return divergences(words, WORD_PROFILES) + CHARACTERS * divergences(chars, CHARACTER_PROFILES)


def measure(texts: list[str]) -> list[dict]:
    """The statistics of texts with at least one visible character each.

    Lines that were broken at a width are joined. Each line, and the paragraph that it stands in, is a distribution of token kinds (function words and what stands beside
    them) and of character classes; the nearest profile by divergence, of the text's language where a profile has one, says what the line is. A text is what most of its
    words are; it is repetition where most of them stand in sentences or lines that came before."""
    docs = []
    all_words, all_chars, paragraph_of, language_of, owner = [], [], [], [], []
    paragraphs = 0
    for n, text in enumerate(texts):
        raw = _LINES.split(text)
        ends = [_ended(x) for x in raw]
        lines: list[str] = []
        at = 0
        for end in [i for i, x in enumerate(raw) if not x or x.isspace()] + [len(raw)]:
            if raw[at:end]:
                joined = [x for x, _ in _unwrap(raw[at:end], ends[at:end])]
                lines += joined
                paragraph_of += [paragraphs] * len(joined)
                paragraphs += 1
            at = end + 1
        tokens = [_TOKEN.findall(b.lower()) for b in _bodies(lines)]
        counts = Counter(chain.from_iterable(tokens))
        language = _language(counts)
        table = KINDS[language]
        all_words.append(_transitions([[table[t] for t in line] for line in tokens]))
        chars = _characters(lines)
        all_chars.append(chars)
        language_of += [language] * len(lines)
        owner += [n] * len(lines)
        seen: set[str] = set()
        again = every = 0
        for line in raw:
            for unit in _SENTENCE.split(line):
                size = unit.count(" ") + 1
                every += size
                if (unit := unit.strip()) in seen:
                    again += size
                elif unit:
                    seen.add(unit)
        letters = sum([c for t, c in counts.items() if t[0].isalpha()])
        common = sum(counts[w] for w in table.common.keys() & counts.keys())
        total = chars.sum(axis=0)
        visible = max(1, int(total[:5].sum()))
        full = [e for x, e in zip(raw, ends) if x and not x.isspace()]
        split = len(text.split())
        docs.append({
            "words": split, "mean_word_length": visible / split if split else 0.0, "symbol_ratio": float(total[3] + total[4]) / visible, "digit_ratio": float(total[1]) / visible, "lines": len(full),
            "ended_lines": sum(full) / max(1, len(full)), "common_words": common / letters if letters else 0.0, "language": language if common else None, "_again": again / max(1, every),
        })
    words, chars = np.concatenate(all_words), np.concatenate(all_chars)
    block, who = np.array(paragraph_of), np.array(owner)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    far = _distance(np.add.reduceat(words, first), np.add.reduceat(chars, first))
    alone = np.bincount(block)[block] == 1
    own = far[block]
    own[~alone] = _distance(words[~alone], chars[~alone])
    allowed = np.stack([_ALLOWED[g] for g in language_of])
    far = np.where(allowed, OWN * own + far[block] - MARGIN * _IS_PROSE, 9.0)
    size = np.maximum(words.sum(axis=1) - 1, 1) + chars[:, [1, 3, 4]].sum(axis=1) // 12
    shares = np.bincount(who * len(_FAMILIES) + _FAMILY_OF[far.argmin(axis=1)], weights=size, minlength=len(docs) * len(_FAMILIES)).reshape(len(docs), -1)
    first = np.flatnonzero(np.diff(who, prepend=-1))
    whole = _distance(np.add.reduceat(words, first), np.add.reduceat(chars, first))
    for n, d in enumerate(docs):
        share = shares[n] / shares[n].sum()
        again = d.pop("_again")
        d["prose_share"] = float(share[0])
        d["divergence"] = float(whole[n][_IS_PROSE & _ALLOWED[d["language"] or LANGUAGES[0]]].min())
        d["profile"] = "repetition" if again > 0.5 else "prose" if share[0] >= 0.5 else _FAMILIES[1 + int(share[1:].argmax())]
    return docs


def statistics(text: str) -> dict:
    """All statistics of a text with at least one visible character."""
    return measure([text])[0]


_COLUMNS = {"words": "long", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "lines": "long", "ended_lines": "double", "common_words": "double", "language": "string", "prose_share": "double", "divergence": "double", "profile": "string"}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the statistics of every document: words (between white space), mean_word_length, symbol_ratio and digit_ratio (of visible characters),
    lines (non-blank), ended_lines (share that ends in sentence punctuation), common_words (share in the language that fits best), language,
    prose_share (of the words in lines nearest to prose), divergence from the language's prose, and the profile: prose, list, table, noise or
    repetition. Null, empty and blank texts have zeros and the profile null. Whole texts are read; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {c: {"long": 0, "double": 0.0, "string": None}[k] for c, k in _COLUMNS.items()}
        for b in blocks(batches):
            texts = b.column(1).to_pylist()
            seen = [bool(t) and not t.isspace() and _visible(t) for t in texts]
            found = iter(measure([t for t, ok in zip(texts, seen) if ok]) if any(seen) else [])
            rows = [next(found) if ok else empty for ok in seen]
            cols = [pa.array([r[c] for r in rows], _ARROW[k]) for c, k in _COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *_COLUMNS])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} {k}" for c, k in _COLUMNS.items()))


def _visible(text: str) -> bool:
    """Whether any character can be seen: not only blanks, controls and marks without width."""
    return any(ch.isprintable() and not ch.isspace() and ch not in "\u200b\u200c\u200d\u2060\ufeff\u00ad\u2800\u3164" for ch in text)


def not_prose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of documents whose nearest structural profile isn't prose. Null, empty and blank texts are no cases."""
    return text_statistics(docs, key, text).filter(F.col("profile").isNotNull() & (F.col("profile") != "prose")).select(key)

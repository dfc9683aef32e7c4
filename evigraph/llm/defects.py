"""Problem 1: broken prompt and response pairs.

Labelling functions vote on each defect of a pair: for it, against it, or not at all. They look at
different things: words, their order, their language by function words and by letter triples, ends of
sentences by form and by what the corpus says. A label model per defect, two classes and one vote
distribution per function and class, is fitted by expectation maximization on the counts of vote
patterns over all rows. A pair keeps every label whose posterior reaches the defect's cutoff, which is
validated on pairs whose label is known: good ones, for their prediction gives a known
answer, and the same ones with a defect put into them.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.tokens import spread
from evigraph.session import attach, cut

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")

MODEL_LIMIT = 4_000_000  # letter triples of all languages; their alphabets bound them far below this
BUCKET = 2_000  # rows that lend each other texts when defects are put into them

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are that it its for on with as by at from this be has have had not which who whom where when what how many did does they there than but after before according both or near about their his her an into during if out no more he she we you them these those been also only other some any all most very can could would over under between because while then",
    "de": "der die das und in im ist war wurde wurden von vom zu zum zur den dem des ein eine einer einem einen mit auf für als nach bei aus an am nicht sich es sie er dort dass wie viele wo wann wer wem welcher welchem welche seit über davon sind werden obwohl etwas auch noch nur schon sehr hat hatte wird kann aber oder um bis unter zwischen wenn weil etwa liegt steht",
    "fr": "le la les l un une des du de d et à au aux en est était fut dans par pour sur qui que qu où quand il elle ils y a ont se son sa ses ce cette ne pas plus après avant selon d'après peu près combien quelle quel mais ou donc leur leurs aussi très sans sous entre chez sont été être avait étaient avaient ces cet trouve",
    "es": "el la los las un una de del y a al en es está fue era por para con que se su sus lo como más no o cuando donde dónde cuándo quién qué cuántas después antes según poco hay son cerca junto aunque pero si ya muy también este esta fueron eran ha había sin sobre entre hasta desde le les unos unas encuentra",
    "it": "il lo la l i gli le un una dell all nell sull di del della dei nel nella e è era fu da dal dalla per con su sul che si non dopo prima secondo anche come se ne poco vicino alla dell'anno nell'anno presso dove quando chi ma più questo questa sono ha hanno stato stata degli alle dai sulla tra fra trova",
    "pt": "o os as um uma de do da dos das e é foi em no na nos nas por para com que se não após depois antes segundo ao aos à mais pouco perto embora ou são tem foram era pelo pela seu sua até sobre entre muito já também este esta fica",
    "nl": "de het een en van in is was werd werden op te voor met aan bij door naar uit dat die er hij zij niet als na om volgens hoewel iets anders toen kort eerste ging maar ook nog dan dit deze heeft hebben had wordt over tussen onder tot hun zijn ze ligt",
    "sv": "och är var en ett av i på som för med den det till inte efter från att vid enligt men också har hade blev om så eller mellan under över sin sitt sina ligger",
}
#: Words by which a question asks for foreign wording.
LANGUAGE_NAMES = "english german french spanish italian portuguese dutch russian latin swedish greek englisch deutsch französisch spanisch italienisch lateinisch anglais allemand français espagnol italien latin russe inglés alemán francés español italiano latín ruso".split()
#: Labels of an answer and wrappings of a repeated question.
ANSWER_LABELS = "a answer the final short answer is antwort die lautet réponse la est respuesta es risposta resposta antwoord ответ prediction output result".split()
QUESTION_WRAPPINGS = "q question you asked the is was frage die lautet sie fragten pregunta la es preguntas preguntaste vous avez demandé question est".split()
#: Openings of an excuse, and words that precede a refusal without being an answer.
OPENERS = "sorry unfortunately regrettably apologies i'm i am afraid but hmm well leider tut mir leid es bedaure désolé désolée malheureusement je suis lo siento lamentablemente desgraciadamente mi dispiace as a an language model ai assistant the with to be honest".split()

_TEXTS = r"(?:passages?|contexts?|documents?|texts?|sources?|excerpts?|evidence|information)"
#: Stems of words for what a reader is given.
TEXT_STEMS = ("passag", "context", "kontext", "document", "dokument", "text", "source", "quelle", "abschnitt", "auszüg", "extrait", "pasaje", "fuente", "fragment", "excerpt", "snippet")
#: What declines or declares itself unable, by language.
REFUSALS = [
    r"\b(?:i|we)(?:'m| am| are|'re|'d| would| will|'ll)? ?(?:really |just |still )?(?:can't|can ?not|couldn't|could not|won't be able|will not be able|am unable|unable|not able|am not able|don't know|do not know|have no idea|rather not|must decline|decline)\b",
    rf"\b{_TEXTS}\b(?: \w+){{0,3}}? (?:do not|does not|did not|don't|doesn't|didn't|cannot|can't|gives? no|give no|contains? no|contains? nothing|has no|have no|hold no|lacks?|leaves?|leave|say nothing|says nothing|are silent|is silent|fails? to|makes? no)\b",
    r"\b(?:isn't|is not|not|wasn't|hardly) (?:\w+ )?possible to\b|\bno way to\b|\b(?:impossible|unable) to (?:answer|determine|tell|say|verify|confirm|know)\b",
    rf"\b(?:not enough|insufficient|too little|no) (?:\w+ )?(?:information|context|evidence|details?)\b|\bno answer (?:could|can|was|is)\b|\bnone of the (?:\w+ ){{0,3}}{_TEXTS}\b",
    r"\b(?:question|this|that|it) (?:can't|can ?not|could not|couldn't|cannot) be (?:answered|determined|verified|confirmed)\b",
    r"\b(?:ich|wir) (?:\w+ ){0,4}(?:nicht|nichts|keine)\b.*\b(?:sagen|beantworten|antworten|wissen|helfen|finden|bestätigen|feststellen)\b|\b(?:kann|können|lässt|weiß)\b[^.]*\b(?:nicht|nichts|keine)\b[^.]*\b(?:beantworten|sagen|antworten|feststellen|bestimmen|entnehmen)\b|\bdazu kann ich\b|\bich weiß (?:es )?nicht\b|\bkeine (?:antwort|angaben?|informationen?)\b|\b(?:texte?n?|kontext|quellen|dokumente?n?) (?:\w+ ){0,3}(?:enthält|enthalten|sagt|sagen|gibt|geben|steht) (?:\w+ ){0,3}(?:nicht|nichts|keine)\b",
    r"\bje (?:ne |n')(?:\w+ )?(?:peux|sais|suis|pourrai|puis|dispose|saurais)\b|\brien n'est dit\b|\bimpossible de (?:répondre|dire|déterminer|savoir|vérifier|confirmer)\b|\b(?:contextes?|textes?|documents?|passages?|sources?) (?:\w+ ){0,2}?(?:ne |n')\w+\b|\bpas (?:assez|suffisamment) d'informations?\b|\bne permet(?:tent)? pas\b|\baucune (?:réponse|information)\b",
    r"\bno (?:puedo|podemos|sé|es posible|se puede|hay (?:suficiente|información|respuesta))\b|\b(?:textos?|contextos?|documentos?|pasajes?|fuentes?) (?:\w+ ){0,2}?no \w+\b|\bimposible (?:responder|saber|decir|determinar)\b|\b(?:ninguna|sin) (?:respuesta|información)\b|\bno lo sé\b",
    r"\bnon (?:posso|so|è possibile)\b|\bnão (?:posso|sei|é possível)\b|\bik (?:kan|weet) (?:\w+ ){0,4}niet\b|\bне (?:могу|знаю)\b",
]
#: Words that cannot end a sentence, by language, beside what the corpus tells.
OPEN_ENDS = set(
    "the a an of and or by in on at to from with for as who which whose where that because was were is are it its their than but when while although after before "
    "der die das den dem des ein eine einen einem einer und oder von vom im in am an auf zu zum zur mit für als weil wurde dass wenn obwohl nach bei durch seit "
    "le la les un une des du de et ou par en à au aux dans sur pour avec qui que dont où parce car mais fut est était après avant selon "
    "el la los las un una unos de del y o por en a al con para que quien cuyo donde porque fue es está era pero cuando aunque después según".split()
)

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
_REFUSALS = [regex.compile(x) for x in REFUSALS]
_SENTENCE = regex.compile(r"(?<=[.!?。])[\"'”»)\]]*\s+|\n+")
_ENDED = regex.compile(r"[.!?。][\"'”»)\]]*\s*$")
_DOTS = regex.compile(r"(?:\.{2,}|…)\s*$")


_NAME_JOINTS = regex.compile(r"(?<=\b\p{Lu}[\p{L}\p{M}'’-]*)(?: (?:of|the|in|von|der|de|du|la|del|und|for)){1,2}(?= \p{Lu})")


def words_of(text: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(text)]


_LEX = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_LEX.values(), OPENERS, "that this these there it question provided retrieved given above contents something can could please try would may".split())
_CYRILLIC = regex.compile(r"\p{Cyrillic}")


@functools.lru_cache(maxsize=100_000)
def _languages(low: str) -> tuple[str, ...]:
    """Languages that a word is a function word of; of one with an apostrophe each part counts."""
    if _CYRILLIC.search(low):
        return ("ru",)
    return tuple(k for k, lex in _LEX.items() if low in lex or ("'" in low and any(p in lex for p in low.split("'"))))


def language_scores(ws: list[str], skip: frozenset[str] | set[str] = frozenset()) -> Counter:
    """Function words of each language among the words; of words that several languages share,
    each gets its part. Capitalised words count only at the start of three words or more, for names
    belong to every language."""
    got: Counter = Counter()
    for i, w in enumerate(ws):
        low = w.lower()
        if low in skip or w[0].isdigit() or (w[0].isupper() and (i or len(ws) < 3)):
            continue
        own = _languages(low)
        for k in own:
            got[k] += 1 / len(own)
    return got


class Triples:
    """Languages by their letter triples: log frequencies and, of texts of the language itself, the
    mean and the spread of a triple's. Fitted on questions whose function words tell their language."""

    def __init__(self, questions: list[str], counts: dict[str, tuple[int, Counter]] | None = None) -> None:
        self.logs: dict[str, dict[str, float]] = {}
        self.usual: dict[str, tuple[float, float]] = {}
        for lang, (texts, n) in (self.counts(questions) if counts is None else counts).items():
            if texts < 20 or not n:
                continue
            total = n.total() + len(n) + 1
            self.logs[lang] = {t: math.log((c + 1) / total) for t, c in n.items()} | {"": math.log(1 / total)}
            x, c = np.array([self.logs[lang][t] for t in n]), np.array(list(n.values()), float)
            mean = float(c @ x / c.sum())
            self.usual[lang] = (mean, math.sqrt(float(c @ (x - mean) ** 2 / c.sum())) + 1e-9)

    @classmethod
    def counts(cls, questions: list[str]) -> dict[str, tuple[int, Counter]]:
        """By language, as told by function words, the number of questions and of their triples."""
        got: dict[str, tuple[int, Counter]] = {}
        for q in questions:
            ws = words_of(q)
            lang = best(language_scores(ws))
            if lang:
                texts, n = got.get(lang, (0, Counter()))
                n.update(cls.of(ws))
                got[lang] = (texts + 1, n)
        return got

    @classmethod
    def fitted(cls, questions: DataFrame) -> Triples:
        """On all questions, each once. Counted in the tasks, then summed; the number of questions of
        a language is the count of its triple of none."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Counter = Counter()
            for batch in batches:
                for lang, (texts, n) in cls.counts([q for q in batch.column(0).to_pylist() if q]).items():
                    sums[lang, ""] += texts
                    for t, c in n.items():
                        sums[lang, t] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums], pa.string()), pa.array([t for _, t in sums], pa.string()), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "t", "n"],
            )

        rows = questions.mapInArrow(run, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")).limit(MODEL_LIMIT + 1).collect()
        if len(rows) > MODEL_LIMIT:
            raise ValueError("the alphabets of the languages are larger than they can be")
        texts = {r["lang"]: r["n"] for r in rows if not r["t"]}
        own: dict[str, Counter] = {lang: Counter() for lang in texts}
        for r in sorted(rows):
            if r["t"]:
                own[r["lang"]][r["t"]] = r["n"]
        return cls([], {lang: (texts[lang], n) for lang, n in sorted(own.items())})

    @staticmethod
    def of(ws: list[str], skip: set[str] | frozenset[str] = frozenset()) -> list[str]:
        """Triples of the words that are no names, numbers or to be skipped."""
        out = []
        for w in ws:
            if w[0].isalpha() and not w[0].isupper() and w not in skip:
                padded = f" {w} "
                out += [padded[i : i + 3] for i in range(len(padded) - 2)]
        return out

    def values(self, triples: list[str], lang: str) -> list[float]:
        logs = self.logs[lang]
        rare = logs[""]
        return [logs.get(t, rare) for t in triples]

    def vote(self, triples: list[str], lang: str | None) -> int:
        """1 if the triples are those of another language or none of this one's, -1 if they are this
        one's, 0 if they are few or the language is unknown."""
        if lang not in self.logs or len(triples) < 8:
            return 0
        mean = {k: sum(self.values(triples, k)) / len(triples) for k in self.logs}
        usual, spread = self.usual[lang]
        off = (mean[lang] - usual) / (spread / math.sqrt(len(triples)))
        other = max((v for k, v in mean.items() if k != lang), default=-99.0)
        if mean[lang] < other - 0.3 or off < -6:
            return 1
        return -1 if mean[lang] > other and off > -3 else 0


def best(scores: Counter) -> str | None:
    top = scores.most_common(2)
    return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else None


def shouted(ws: list[str]) -> bool:
    """Whether a text is set in capitals, or in capitalised words, so that capitals tell no names."""
    return len(ws) >= 4 and sum(w[0].isupper() for w in ws) > 0.7 * sum(not w[0].isdigit() for w in ws)


def masked(text: str) -> list[str]:
    """Words of a sentence with names as ``N`` and numbers as ``#``; both are open classes."""
    return ["#" if w[0].isdigit() else "N" if w[0].isupper() else w for w in words_of(text)]


def sentences(text: str) -> tuple[list[str], str]:
    """Ended sentences, and the rest after the last end."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p and p.strip()]
    done = [p for p in parts if _ENDED.search(p) and not _DOTS.search(p)]
    rest = parts[-1] if parts and (not _ENDED.search(parts[-1]) or _DOTS.search(parts[-1])) else ""
    return done, _DOTS.sub("", rest)


def tail(text: str) -> tuple[str, str] | None:
    """The last two words of an unended rest."""
    rest = sentences(text)[1]
    ws = ["^", *masked(rest)]
    return (ws[-2], ws[-1]) if rest and len(ws) > 1 else None


def votes(question: str | None, prediction: str | None, answers: list[str] | None, contexts: list[str], triples: Triples | None = None) -> list[int]:
    """Votes of the labelling functions, by defect: 1 for it, -1 against it, 0 none. Those on what
    may end a sentence follow from the corpus, see :func:`label`."""
    q, p = question or "", (prediction or "").replace("\u200b", "")
    spans = [(m.start(), m[0].replace("’", "'")) for m in _WORD.finditer(p)]
    qw, pw = words_of(q), [w for _, w in spans]
    ql, pl = [w.lower() for w in qw], [w.lower() for w in pw]
    qs = set(ql)
    low = " ".join(p.lower().replace("’", "'").split())
    loud = shouted(pw)

    # empty: no word; a label alone; something said
    bare = all(w in ANSWER_LABELS for w in pl)
    said = [w for w in pl if w not in ANSWER_LABELS]
    empty = [1 if not pl else 0, 1 if pl and bare and (p.rstrip()[-1:] in ":：-" or len(pl) > 1) else 0, -1 if said else 0]

    # copies_question: words beyond the question's; the question's order; how much of it is there
    rest = [w for w in pl if w not in qs and w not in QUESTION_WRAPPINGS and w not in ANSWER_LABELS]
    over = len(qs & set(pl)) / max(1, len(qs))
    i = 0
    for w in pl:  # words of the question in its own order
        if i < len(ql) and w == ql[i]:
            i += 1
    ordered = i / max(1, len(ql))
    copies = [
        -1 if rest or not pl else 1 if qs else 0,
        -1 if not qs or ordered < 0.4 else 1 if ordered >= 0.75 and not rest else 0,
        -1 if not qs or over < 0.5 else 1 if over >= 0.8 and not rest else 0,
    ]

    # refusal: words that decline, which nothing precedes; an apology; an answer
    hit = min((m for m in (r.search(low) for r in _REFUSALS) if m), key=lambda m: m.start(), default=None)
    known = any(a and a.lower() not in q.lower() and a.lower() in p.lower() for a in answers or [])
    fresh = False
    if hit and not known:
        german = best(language_scores(pw)) == "de"  # capitals tell no names there
        for k, ((at, w), x) in enumerate(zip(spans, pl)):
            near = pl[max(0, k - 2) : k + 4]
            if x in qs or (w[0].isdigit() and any(y.startswith(TEXT_STEMS) for y in near)) or (x in _ANY and w[0].isupper()):
                continue
            while at and p[at - 1].isspace():
                at -= 1
            start = k == 0 or p[at - 1 : at] in (".", "!", "?", ":", ",", "")
            fresh |= w[0].isdigit() or (w[0].isupper() and not loud and not start and not german and x not in ("i", "i'm", "i'd", "i'll", "ai"))
    elif not known:
        fresh = any(w[0].isdigit() or (w[0].isupper() and k and not loud) for k, (w, x) in enumerate(zip(pw, pl)) if x not in qs)
    before = words_of(low[: hit.start()]) if hit else []
    led = [w for w in before if w not in _ANY and w not in qs and not w[0].isdigit() and not w.startswith(TEXT_STEMS)]
    led += [w for w in before if w in ("one", "yes", "no", "ja", "oui", "sí")]
    opener = low.startswith(("sorry", "unfortunately", "regrettably", "i'm sorry", "i am sorry", "i'm afraid", "leider", "es tut mir leid", "désolé", "malheureusement", "lo siento", "as a language model", "as an ai"))
    refusal = [
        1 if hit and not led else -1,
        1 if opener else 0,
        -1 if known or fresh or not pl else 0,
    ]

    # other_language: words that aren't the question's own, without the small words inside names
    pn, qn = words_of(_NAME_JOINTS.sub("", p)), words_of(_NAME_JOINTS.sub("", q))
    pn, qn = ([w.lower() for w in ws] if shouted(ws) else ws for ws in (pn, qn))
    own = {w.lower() for w in qn}
    ps, qsc, whole = language_scores(pn, own), language_scores(qn), language_scores(pn)
    mine = best(qsc)
    most, all_most = (max(x.values(), default=0.0) for x in (ps, whole))  # which of several languages doesn't matter
    asked = any(w in LANGUAGE_NAMES for w in ql)
    foreign = mine is not None and most > ps[mine] and all_most > whole[mine]
    other = [
        0 if asked else 1 if foreign and most - ps[mine] >= 0.5 else -1 if mine and best(ps) == mine else 0,
        0 if asked else 1 if foreign and most >= 1 else -1 if mine and best(whole) == mine else 0,
        -1 if asked or not ps or not pl else 0,
        1 if mine not in ("ru", None) and not asked and _CYRILLIC.search("".join(w for w in pl if w not in qs)) else 0,
        0 if asked or triples is None else triples.vote(triples.of(pn, own), mine),
    ]

    # truncated: an open bracket; an open quotation or list; a word that nothing follows; half a word
    done, open_rest = sentences(p)
    final = words_of(open_rest)
    last = final[-1] if final else ""
    text = p.rstrip()
    brackets = sum(text.count(x) for x in "([{") > sum(text.count(x) for x in ")]}")
    quotes = text.count('"') % 2 == 1 or text.count("“") > text.count("”") or text.count("«") > text.count("»")
    dangling = bool(open_rest) and (open_rest.rstrip()[-1:] in ",;-–—/&" or (last.islower() and last in OPEN_ENDS and len(pl) > 1))
    if dangling and ql and pl and pl[-1] != ql[-1]:
        copies = [0, -1, -1]  # it breaks off where the question does not
    listed = bool(regex.search(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•])\s*$", text)) and len(pl) > 1
    cut_word = False
    if len(last) >= 2 and len(pl) > 1:
        parts = {w for t in [q, *(answers or []), *contexts] if t and last in t.replace("’", "'") for w in words_of(t)}
        cut_word = last not in parts and any(w.startswith(last) for w in parts)
    ended = bool(done) and not open_rest
    truncated = [
        1 if brackets else 0,
        1 if quotes or listed else 0,
        1 if dangling else 0,
        1 if cut_word else 0,
        -1 if (ended and not brackets and not quotes and not listed) or not pl else 0,
    ]
    return [*empty, *copies, *refusal, *other, *truncated]


#: Votes of :func:`votes` by defect, as slices; truncated gets one more from the corpus.
SLICES = {"empty": (0, 3), "copies_question": (3, 6), "refusal": (6, 9), "other_language": (9, 14), "truncated": (14, 20)}


def posterior(patterns: list[tuple[int, ...]], theta: np.ndarray, prior: float) -> np.ndarray:
    """Of each vote pattern that of the defect."""
    v = np.asarray(patterns, np.int64).reshape(len(patterns), -1) + 1
    logp = [np.log(theta[y][np.arange(v.shape[1]), v]).sum(axis=1) for y in range(2)]
    return 1 / (1 + np.exp(-np.clip(logp[1] - logp[0] + np.log(prior / (1 - prior)), -50, 50)))


def fit(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 60) -> np.ndarray:
    """Posterior of the defect for each vote pattern, see :func:`model`."""
    return posterior(patterns, *model(patterns, counts, rounds)) if patterns else np.zeros(0)


def model(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 60) -> tuple[np.ndarray, float]:
    """Vote distributions by class, function and vote, and the share of the defect, by expectation
    maximization.

    One class is the defect, the other none; given the class, functions vote independently. The
    start trusts each vote at nine to one; a Dirichlet prior of that shape, worth PRIOR of the
    rows, keeps rare functions from trading places with the class."""
    v = np.asarray(patterns, np.int64).reshape(len(patterns), -1) + 1  # 0 against, 1 none, 2 for
    n = np.asarray(counts, np.float64)
    m = v.shape[1]
    base = np.stack([np.bincount(v[:, j], weights=n, minlength=3) for j in range(m)]) / n.sum()
    shape = np.empty((2, m, 3))
    for y in range(2):
        tilt = np.array([0.1, 1.0, 0.9]) if y else np.array([0.9, 1.0, 0.02])
        shape[y] = (base + 1e-4) * tilt if not y else (np.array([0.02, 0.38, 0.6]))[None, :]
        shape[y] /= shape[y].sum(axis=1, keepdims=True)
    theta, prior = shape.copy(), 0.02
    strength = max(20.0, 0.002 * n.sum())
    for _ in range(rounds):
        post = posterior(patterns, theta, prior)
        for y in range(2):
            w = n * (post if y else 1 - post)
            for j in range(m):
                seen = np.bincount(v[:, j], weights=w, minlength=3) + strength * shape[y][j]
                theta[y][j] = seen / seen.sum()
        prior = float(np.clip((n @ post + 1) / (n.sum() + 50), 1e-4, 0.5))
    return theta, prior


GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)  # cutoffs tried


def validated(post: np.ndarray, counts: np.ndarray, good: np.ndarray, made: np.ndarray | None = None, most: float = 0.002, many: np.ndarray | None = None) -> float:
    """The cutoff of the grid that catches most of the pairs into which the defect was put
    (posteriors ``made``, each of ``many`` pairs), the lowest of equal ones, among those at which at most ``most`` of the
    pairs that are known to be good would be flagged."""
    right = [c for c in GRID if good @ (post >= c) <= most * max(1.0, good.sum())] or [GRID[-1]]
    many = np.ones(0 if made is None else len(made)) if many is None else many
    return max(right, key=lambda c: ((made >= c) @ many if made is not None else 0, -c))


#: Plain ways to decline, for validation.
DECLINED = [
    "I don't know.", "There is not enough information to answer this question.", "Sorry, I cannot answer that.",
    "Das kann ich nicht beantworten.", "Ich weiß es nicht.", "Je ne sais pas.", "Il est impossible de répondre.", "No lo sé.", "No puedo responder a esta pregunta.",
]


def damaged(rows: list[tuple], triples: Triples) -> tuple[list[tuple], dict[str, list[tuple]]]:
    """``(good, made)``, each as ``(votes, tail)``: the rows ``(id, question, prediction, answers,
    contexts)`` whose prediction is a known answer; and by defect rows whose prediction gives a known
    answer and ends as a sentence does, with that defect put into them. Which row gets what depends
    on its id only."""
    plain = lambda t: " ".join(words_of(t or "")).lower()
    kept, base = [], []
    for i, q, p, answers, contexts in sorted(rows):
        if not q or not p or not plain(p):
            continue
        if any(plain(p) == plain(a) for a in answers or []):
            kept.append((votes(q, p, answers, contexts or [], triples), tail(p)))
        if any(a and a.lower() in p.lower() and a.lower() not in q.lower() for a in answers or []) and not sentences(p)[1]:
            base.append((_digest(i), q, p, answers, contexts or [], best(language_scores(words_of(q)))))
    made: dict[str, list[tuple]] = {d: [] for d in DEFECTS}
    for at, (seed, q, p, a, c, lang) in enumerate(base):
        _, _, other, _, _, tongue = base[(at + 1 + seed % 97) % len(base)]
        now = {"empty": ("", "...", "Answer:", " - ")[seed % 4], "copies_question": (q, f"Question: {q}", q.rstrip("?? ").lower())[seed % 3], "refusal": DECLINED[seed % len(DECLINED)]}
        ws = other.split()
        if tongue != lang and tongue and len(ws) > 3 and not any(w.lower() in LANGUAGE_NAMES for w in words_of(q)):
            now["other_language"] = other
        if tongue == lang and len(ws) > 4:
            now["truncated"] = f"{p} {' '.join(ws[: 2 + seed % (len(ws) - 3)])}"
        for defect, text in now.items():
            made[defect].append((votes(q, text, a, c, triples), tail(text)))
    return kept, made


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _features(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        v, good, a, b, h = [], [], [], [], []
        for _, q, p, ans, ctx in zip(*cols):
            v.append(votes(q, p, ans, ctx or [], held.value))
            plain = " ".join(words_of(p or "")).lower()
            good.append(bool(plain) and any(plain == " ".join(words_of(x or "")).lower() for x in ans or []))
            pair = tail(p) if p else None
            a.append(pair[0] if pair else None)
            b.append(pair[1] if pair else None)
            h.append(_digest(p) if pair else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(v, pa.list_(pa.int8())), pa.array(good), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(h, pa.int64())],
            names=["id", "v", "good", "w1", "w2", "h"],
        )


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of words ends a sentence and how often it goes on, over all rows and
    over distinct predictions."""
    counts = [Counter() for _ in range(4)]
    ends, goes, ends1, goes1 = counts
    for batch in batches:
        for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not p:
                continue
            done, rest = sentences(p)
            for s, ended in [*((s, True) for s in done), (rest, False)]:
                ws = ["^", *masked(s)]
                pairs = list(zip(ws, ws[1:]))
                for k in pairs[:-1]:
                    goes[k] += n
                    goes1[k] += 1
                for k in pairs[-1:] if ended else []:
                    ends[k] += n
                    ends1[k] += 1
    keys = list(ends.keys() | goes.keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]],
        names=["w1", "w2", "ends", "goes", "ends1", "goes1"],
    )


def _damaged(held, table: pa.Table) -> pa.Table:
    """Of a bucket of rows those of :func:`damaged`, counted by votes and tail; good ones have no defect."""
    rows = {r["id"]: tuple(r[c] for c in ("id", "question", "prediction", "answers", "contexts")) for r in table.to_pylist()}
    kept, made = damaged(list(rows.values()), held.value)
    n = Counter(("", tuple(v), t) for v, t in kept)
    for defect, got in made.items():
        n.update((defect, tuple(v), t) for v, t in got)
    return pa.table(
        [
            pa.array([d for d, _, _ in n], pa.string()), pa.array([v for _, v, _ in n], pa.list_(pa.int8())), pa.array([t and t[0] for _, _, t in n], pa.string()),
            pa.array([t and t[1] for _, _, t in n], pa.string()), pa.array(list(n.values()), pa.int64()),
        ],
        names=["defect", "v", "w1", "w2", "n"],
    )


def labelled(rows: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """``(labels, cutoffs)``: :func:`label`, and of each defect ``(defect, cutoff, good, alarms,
    made, caught)`` as validated on all rows: those that are known to be good and how many of them
    were flagged, those into which the defect was put and how many of those were."""
    spark = attach(rows.sparkSession)
    src = rows.where("id is not null").select(
        "id", "question", "prediction", "answers", F.transform("contexts", lambda c: c["text"]).alias("contexts")
    )
    held = spark.sparkContext.broadcast(Triples.fitted(src.select("question").where("question is not null").distinct()))
    buckets = -(-max(1, src.count()) // BUCKET)
    tried = (
        src.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("_b")
        .applyInArrow(lambda part: _damaged(held, part), "defect string, v array<tinyint>, w1 string, w2 string, n long")
        .groupBy("defect", "v", "w1", "w2").agg(F.sum("n").alias("n"))
    )
    tried = cut(tried)  # used twice
    feats = spread(src, "id").mapInArrow(lambda batches: _features(held, batches), "id string, v array<tinyint>, good boolean, w1 string, w2 string, h long")
    feats = cut(feats.dropDuplicates(["id"]))  # votes are dear and used twice
    texts = src.select("id", "prediction")
    cores = spark.sparkContext.defaultParallelism
    small = texts.rdd.getNumPartitions() < 2 * cores
    texts = texts.groupBy("prediction").agg(F.count_distinct("id").alias("n"))  # copies are read once, redelivered rows count once
    stats = (
        (texts.repartition(4 * cores, "prediction") if small else texts)
        .mapInArrow(_endings, "w1 string, w2 string, ends long, goes long, ends1 long, goes1 long")
        .groupBy("w1", "w2").agg(*[F.sum(c).alias(c) for c in ("ends", "goes", "ends1", "goes1")])
    )
    stats = cut(stats)  # used three times
    words = stats.groupBy("w2").agg(F.sum(F.col("ends") + F.col("goes")).alias("seen"))
    starts = (
        stats.where(~F.col("w2").isin("N", "#") & (F.length("w2") > 1))
        .select("w1", F.explode(F.transform(F.sequence(F.lit(1), F.length("w2") - 1), lambda n: F.substring("w2", F.lit(1), n))).alias("w2"))
        .distinct().withColumn("starts", F.lit(True))
    )
    # the unended rests that occur, each once: few rows, however many rows end so
    tails = feats.where("w2 is not null").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n1"))
    extra = tried.where("w2 is not null").select("w1", "w2").distinct()
    tails = tails.unionByName(extra.join(tails, ["w1", "w2"], "left_anti").select("w1", "w2", F.lit(0).alias("n"), F.lit(0).alias("n1")))
    zero = F.lit(0)
    ends, goes, ends1, goes1, seen = (F.coalesce(c, zero) for c in ("ends", "goes", "ends1", "goes1", "seen"))

    def goes_on(ends, goes, n):
        return (
            F.when(ends > 0.05 * goes, F.when(ends > 0, -1).otherwise(0))
            .when((goes >= 3) & (n < 0.2 * goes), 1)  # rests are cut anywhere, so few at any one place
            .otherwise(0)
        )

    # distinct predictions first, for a text may recur in many rows; where they are too few to tell, rows
    apart = goes_on(ends1, goes1, F.col("n1"))
    judged = (
        tails.join(stats, ["w1", "w2"], "left").join(words, "w2", "left").join(starts, ["w1", "w2"], "left").select(
            "w1", "w2",
            F.when((seen == 0) & F.col("starts"), 1)  # no word, but the start of one that goes on here
            .when(F.col("w2").isin("N", "#"), F.when(ends > 0, -1).otherwise(0))
            .when(apart == 1, 1)
            .otherwise(goes_on(ends, goes, F.col("n"))).cast("tinyint").alias("t"),
        )
    )
    judged = cut(judged)

    def told(df: DataFrame, *keep: str) -> DataFrame:
        return df.join(judged, ["w1", "w2"], "left").select(*keep, F.concat("v", F.array(F.coalesce("t", F.lit(0).cast("tinyint")))).alias("v"))

    full, tried = cut(told(feats, "id", "good")), cut(told(tried, "defect", "n"))
    out, cutoffs = full, []
    for name, (a, b) in SLICES.items():
        part = F.slice("v", a + 1, b - a)
        # at most 3 to the power of the defect's functions rows
        got = full.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("g")).collect()
        if not got:
            continue
        patterns = [tuple(r["p"]) for r in got]
        counts, good = np.array([r["n"] for r in got], float), np.array([r["g"] for r in got], float)
        fitted = model(patterns, [r["n"] for r in got])
        post = posterior(patterns, *fitted)
        sums = tried.where(F.col("defect").isin("", name)).groupBy("defect", part.alias("p")).agg(F.sum("n").alias("n")).collect()
        known, made = ([(tuple(r["p"]), r["n"]) for r in sorted(sums) if r["defect"] == d] for d in ("", name))
        known_n, made_n = (np.array([n for _, n in x], float) for x in (known, made))
        known_post, made_post = (posterior([p for p, _ in x], *fitted) if x else np.zeros(0) for x in (known, made))
        c = validated(post, counts, good, made_post, many=made_n)
        cutoffs.append((name, c, int(known_n.sum()), int(known_n @ (known_post >= c)), int(made_n.sum()), int(made_n @ (made_post >= c))))
        kept = [(list(p), float(x)) for p, x in zip(patterns, post) if x >= c]
        table = spark.createDataFrame(kept, f"_p array<tinyint>, {name} double")
        out = out.join(F.broadcast(table), part == F.col("_p"), "left").drop("_p")
    have = [n for n in SLICES if n in out.columns]
    labels = F.filter(
        F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("defect"), F.col(n).alias("posterior"))) for n in have]) if have
        else F.array().cast("array<struct<defect:string,posterior:double>>"),
        lambda x: x.isNotNull(),
    )
    return out.select("id", labels.alias("labels")), cutoffs


def label(rows: DataFrame) -> DataFrame:
    """``(id, labels ARRAY<STRUCT<defect, posterior>>)`` of every run row.

    A null or empty prediction is ``empty``; null questions, answers or contexts leave the functions
    that need them without a vote; redelivered rows count once; rows without id are left out. Whole
    texts are read. Per defect only the counts of vote patterns, at most 3 to the power of its
    functions, come to the driver, besides the counts of letter triples by language.
    """
    return labelled(rows)[0]


def cutoffs(rows: DataFrame) -> DataFrame:
    """``(defect, cutoff, good, alarms, made, caught)``, see :func:`labelled`."""
    got = labelled(rows)[1]
    return rows.sparkSession.createDataFrame(got, "defect string, cutoff double, good long, alarms long, made long, caught long")


def found(rows: DataFrame) -> DataFrame:
    """``(id, defect)``: of each defective row the label with the highest posterior; of equal ones
    the first in the order of DEFECTS."""
    top = F.array_sort(
        "labels",
        lambda a, b: F.when(F.round(a["posterior"], 2) > F.round(b["posterior"], 2), -1)
        .when(F.round(a["posterior"], 2) < F.round(b["posterior"], 2), 1)
        .otherwise(F.array_position(F.array(*map(F.lit, DEFECTS)), a["defect"]) - F.array_position(F.array(*map(F.lit, DEFECTS)), b["defect"]))
        .cast("int"),
    )
    return label(rows).where(F.size("labels") > 0).select("id", top[0]["defect"].alias("defect"))

"""Languages of pages and paragraphs by error-correcting output codes over character n-grams.

Each language has a codeword; one linear classifier per bit predicts it from hashed n-grams of the
paragraph's words. Decoding adds the bits' logistic losses, weighted by how reliable each bit proved in
training, and takes the nearest codeword; a narrow lead over the second is flagged as ambiguous.

The classifiers are fitted on the driver, on the paragraphs of at most TRAIN_PAGES labelled pages picked
by hash of their id. Labels may be wrong, so they are first judged by classifiers fitted on the other
pages: in every fold, a paragraph whose label isn't what they say is dropped from the final fit. Everything else runs over all rows.

Edge cases: a page without text has no paragraphs; a paragraph without letters gets no language; a label
that is empty or names no language is null; languages without labelled pages are known from their
function words alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "da")
TRAIN_PAGES = 1_500
FOLDS = 3
BUCKETS = 1 << 16
BITS = 15
#: A lead of the best codeword over the second below this is ambiguous.
AMBIGUOUS = 0.75

# Notations of languages; a region after - or _ is cut off first.
_NAMES = {
    "en": "eng english englisch anglais inglés ingles inglese engels engelsk", "de": "deu ger german deutsch allemand alemán aleman tedesco duits tysk", "fr": "fra fre french français francais französisch francés francese frans fransk",
    "es": "spa spanish español espanol castellano spanisch espagnol spagnolo spaans spansk", "it": "ita italian italiano italienisch italien italiaans italiensk", "nl": "nld dut dutch nederlands niederländisch néerlandais flemish vlaams hollandsk",
    "da": "dan danish dansk dänisch danois danés danese deens", "pt": "por portuguese português", "sv": "swe swedish svenska", "no": "nor nb nn nob nno norwegian norsk", "fi": "fin finnish suomi", "pl": "pol polish polski", "cs": "ces cze czech",
    "ru": "rus russian", "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean", "el": "ell gre greek", "tr": "tur turkish", "hu": "hun hungarian", "ro": "ron rum romanian", "bg": "bul bulgarian", "ar": "ara arabic", "uk": "ukr ukrainian",
}
LABELS = {w: code for code, names in _NAMES.items() for w in [code, *names.split()]}
# Commonest words, the least that is known of a language without labelled pages.
_SEED = {
    "en": "the of and to in a is for was on by with from that which their this were have been at as its are be it not or an",
    "de": "der die das und von in den dem des zu mit auf für ist war im eine einen wurde werden sich nicht nach bei als auch aus durch an es",
    "fr": "le la les de des du et en un une au aux est dans sur pour par que qui dont plus été avec ce cette sont leurs ses à",
    "es": "el la los las de y del al en con por para un una se su sus como más fue que es han sido lo sobre entre",
    "it": "il lo la gli le i di e del della dei delle che in per un una con su nel alla sono è stata come più dal al",
    "nl": "de het een van en in op te voor met door werd niet zijn over om bij aan dat die is als hun worden uit nog naar",
    "da": "den det og af til en et i er på for med som fra blev ved sin deres har at der de ikke var efter om mellem",
}
_WORD = re.compile(r"[^\W\d_]+")


#: Two or more capitalised words in a row: most likely a name, whose words may be of any language.
_NAME = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ][^\W\d_]*[a-zß-ÿ](?:[\s&\-]+(?:and\s+)?[A-ZÀ-ÖØ-Þ][^\W\d_]*[a-zß-ÿ])+")


def words_of(text: str) -> list[str]:
    """The lower-case words of a text without those of names, unless little else is left."""
    bare = _WORD.findall(_NAME.sub(" ", text).lower())
    return bare if len(bare) >= 5 else _WORD.findall(text.lower())


def label_code(label: str | None) -> str | None:
    """The language that a label names, in two letters."""
    head = re.split(r"[-_(]", label.strip().lower(), maxsplit=1)[0].strip() if label else ""
    return LABELS.get(head)


def paragraphs(text: str) -> list[str]:
    """Maximal runs of lines that aren't blank."""
    found, run = [], []
    for line in text.split("\n"):
        if line.strip():
            run.append(line)
        elif run:
            found.append("\n".join(run))
            run = []
    if run:
        found.append("\n".join(run))
    return found


def letters_and_share(paragraph: str) -> tuple[int, float]:
    """How many letters a paragraph has, and their share of what isn't white space."""
    letters = sum(map(len, _WORD.findall(paragraph)))
    solid = sum(map(len, paragraph.split()))
    return letters, letters / solid if solid else 0.0


def ngram_ids(word: str) -> list[int]:
    """Buckets of the 1- to 4-grams of a word between blanks."""
    padded = f" {word} "
    return [zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)]


def codewords(classes: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """classes x bits of +1 and -1: of many random codes without trivial columns, the one whose words are farthest apart."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(500):
        code = rng.choice([-1, 1], (classes, bits))
        if (np.abs(code.sum(0)) == classes).any():
            continue
        apart = min(int((code[a] != code[b]).sum()) for a in range(classes) for b in range(a))
        if apart > far:
            best, far = code, apart
    return best.astype(np.float32)


def shares_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text's n-grams and their shares."""
    cached: dict[str, list[int]] = {}
    samples = []
    for t in texts:
        ids = [i for w in words_of(t) for i in (cached.get(w) or cached.setdefault(w, ngram_ids(w)))]
        u, c = np.unique(np.array(ids, np.int64), return_counts=True)
        samples.append((u, (c / max(1, c.sum())).astype(np.float32)))
    return samples


class LanguageModel:
    """Linear bit classifiers over n-grams; a word's contribution to every bit is computed once and kept."""

    KEEP = 200_000

    def __init__(self, classes: tuple[str, ...], bits: int = BITS):
        self.classes, self.code = classes, codewords(len(classes), bits)
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        self.bias = np.zeros(bits, np.float32)
        self.trust = np.ones(bits, np.float32)
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.sums, self.sizes = np.zeros((1024, self.code.shape[1]), np.float32), np.zeros(1024, np.float32)

    def __getstate__(self):
        return self.classes, self.code, self.weights, self.bias, self.trust

    def __setstate__(self, state):
        self.classes, self.code, self.weights, self.bias, self.trust = state
        self._reset()

    def fit(self, samples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 3, rate: float = 0.5) -> None:
        """Logistic regression for every bit at once, with AdaGrad steps. samples: shares_of() of each text."""
        rng = np.random.default_rng(3)
        seen = np.full(self.weights.shape, 1e-6, np.float32)
        target = self.code[np.array(labels)]
        scale = np.float32(20)
        for _ in range(epochs):
            for k in rng.permutation(len(samples)):
                u, x = samples[k]
                if not len(u):
                    continue
                x = x * scale
                f = x @ self.weights[u] + self.bias
                step = -target[k] / (1 + np.exp(np.clip(target[k] * f, -30, 30)))
                g = x[:, None] * step
                seen[u] += g * g
                self.weights[u] -= rate * g / np.sqrt(seen[u])
        self.weights *= scale
        right = (np.sign(self.sample_margins(samples)) == np.sign(target)).mean(0) if samples else np.ones(len(self.bias))
        self.trust = np.maximum(right - 0.5, 0.01).astype(np.float32)
        self.trust /= self.trust.sum()

    def sample_margins(self, samples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """margins() of texts whose n-grams are counted already."""
        return np.array([x @ self.weights[u] + self.bias for u, x in samples]).reshape(len(samples), len(self.bias))

    def _slot(self, word: str) -> int:
        at = len(self.slots)
        if at == len(self.sizes):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        ids = ngram_ids(word)
        self.sums[at], self.sizes[at] = self.weights[ids].sum(0), len(ids)
        self.slots[word] = at
        return at

    def margins(self, texts: list[str]) -> np.ndarray:
        """texts x bits: the mean weight of a text's n-grams for every bit."""
        if len(self.slots) > self.KEEP:
            self._reset()
        slots, starts = [], []
        get, new = self.slots.get, self._slot
        for t in texts:
            starts.append(len(slots))
            for w in words_of(t):
                s = get(w)
                slots.append(new(w) if s is None else s)
            slots.append(-1)
        if not starts:
            return np.zeros((0, len(self.bias)), np.float32)
        at = np.array(slots)
        sums = np.where((at >= 0)[:, None], self.sums[at], 0)
        sizes = np.where(at >= 0, self.sizes[at], 0)
        total, n = np.add.reduceat(sums, starts, axis=0), np.add.reduceat(sizes, starts)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, confidence) of each row, by the least loss over the bits of a codeword."""
        agree = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agree) * self.trust).sum(2)
        # the code's words are apart in many bits: the sum of the losses, not their mean, is the evidence
        odds = np.exp(-(loss - loss.min(1, keepdims=True)) * len(self.trust))
        share = odds / odds.sum(1, keepdims=True)
        return share.argmax(1), share.max(1)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, classes: tuple[str, ...] = LANGUAGES) -> LanguageModel:
    """Fit on the labelled paragraphs of at most train_pages pages."""
    # only hashes below a share of their range are looked at, so that no task returns more than its part of the sample
    share = min(1.0, 4 * train_pages / max(1, pages.count()))
    labelled = pages.where(F.col("language").isNotNull() & (F.trim("language") != "") & (F.length("text") >= 80)).withColumn("h", F.xxhash64("id"))
    within = labelled.where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    sample = within.select("language", "text", "h").orderBy("h", "text").limit(train_pages).select("language", "text").collect()
    texts, labels, folds = [], [], []
    for k, r in enumerate(sample):
        code = label_code(r.language)
        if code in classes:
            own = [p for p in paragraphs(r.text) if (lambda x: x[0] >= 80 and x[1] >= 0.7)(letters_and_share(p))]
            texts += own
            labels += [classes.index(code)] * len(own)
            folds += [k % FOLDS] * len(own)
    seeds = [_SEED[c] for c in classes if c in _SEED for _ in range(10)]
    seed_labels = [classes.index(c) for c in classes if c in _SEED for _ in range(10)]

    samples, seed_samples = shares_of(texts), shares_of(seeds)

    def fitted(which: list[int], epochs: int) -> LanguageModel:
        model = LanguageModel(classes)
        model.fit([samples[k] for k in which] + seed_samples, [labels[k] for k in which] + seed_labels, epochs)
        return model

    keep: list[int] = []
    for fold in range(FOLDS):
        held = [k for k, f in enumerate(folds) if f == fold]
        if held:
            judge = fitted([k for k, f in enumerate(folds) if f != fold], 1)
            said, _ = judge.decode(judge.sample_margins([samples[k] for k in held]))
            keep += [k for k, a in zip(held, said) if a == labels[k]]
    return fitted(sorted(keep), 3)


_OUT = "page_id string, para_no long, letters int, is_prose boolean, label_code string, lang_code string, confidence double, ambiguous boolean"


def paragraph_languages(pages: DataFrame, model: LanguageModel | None = None, min_letters: int = 80, min_share: float = 0.7) -> DataFrame:
    """Each paragraph of each page with its language, confidence, and the language that the page's label names."""
    model = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array(own.classes, object)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                rows, texts = [], []
                for page_id, language, text in zip(part["id"], part["language"], part["text"]):
                    code = label_code(language)
                    for no, p in enumerate(paragraphs(text), 1):
                        letters, share = letters_and_share(p)
                        if letters:
                            rows.append((page_id, no, letters, letters >= min_letters and share >= min_share, code))
                            texts.append(p)
                best, sure = own.decode(own.margins(texts))
                out = pd.DataFrame(rows, columns=["page_id", "para_no", "letters", "is_prose", "label_code"])
                out["lang_code"], out["confidence"] = names[best] if len(rows) else [], sure.astype(float)
                out["ambiguous"] = out["confidence"] < AMBIGUOUS
                yield out

    return pages.where(F.length("text") > 0).select("id", "language", "text").mapInPandas(classify, _OUT)


def foreign_paragraphs(pages: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """page_id, para_no, lang_code of each prose paragraph that isn't in the language of its page's label."""
    known = paragraph_languages(pages, model).where("is_prose")
    return known.where(~F.col("lang_code").eqNullSafe(F.col("label_code"))).select("page_id", "para_no", "lang_code")


def page_languages(pages: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """page_id, lang_code (of most letters), confidence, n_languages of the prose paragraphs; pages without letters are left out."""
    known = paragraph_languages(pages, model)
    by = known.groupBy("page_id", "lang_code").agg(
        F.sum("letters").alias("letters"), F.sum(F.col("confidence") * F.col("letters")).alias("weighted"), F.max("is_prose").alias("prose")
    )
    return by.groupBy("page_id").agg(
        F.max_by("lang_code", F.struct("letters", "lang_code")).alias("lang_code"),
        (F.max_by("weighted", F.struct("letters", "lang_code")) / F.sum("letters")).alias("confidence"),
        F.count_if("prose").alias("n_languages"),
    )

r"""Quality rules: base counts of a text, and a linear-chain conditional random field over its lines.

Each line that holds a word is labelled content or boilerplate by Viterbi decoding; the share of words in content lines
decides whether the document stays.  The base counts fail a document before that.  Words are the runs of
``[^\x20\x09-\x0D]``.

The field has features of the line (length, symbols, case, digits, end mark, repeated words, links, licence and site words
of five languages) and transitions between neighbouring lines.  Site words and links speak for boilerplate before anything
is learned (``PRIOR``, the mean that the regularisation pulls their weights to), so notices and site furniture are found
where the sample shows few of them.  The field is fitted by gradient steps on the exact likelihood over a bounded sample of
labelled documents (``MAX_PER_CLASS`` of each quality with at most ``MAX_LINES`` lines and ``MAX_TRAIN_CHARS``
characters; the smallest hashes of their id; ids with crc32 mod 3 = 1 are held out).  All documents are then decoded
whole, whatever their number of lines.

The labels are of documents, the states of lines are latent.  A logistic fit tells how well each line fits good documents
rather than bad ones; a line that fits bad ones, or that is full of site words, starts as boilerplate wherever it stands,
so a bad document keeps its clean lines as content.  The label of the document only bounds the share: at least half the
words of a bad document are boilerplate and at least half of a good one are content, the least certain lines giving way.
The field is fitted to these states, decodes them anew under the same bounds, and is fitted again (``ROUNDS``), so its
transitions are those within mixed documents.

Everything runs over slices of an Arrow batch with numpy: all lines of a slice at once, Viterbi over all documents of a
slice step by step.

Defined results: a null text has no words, so it fails the base rules; so does an empty one; lines without a word count
nowhere; equal rows stay; without labels of both qualities every line is content; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, text_slices
from .compression_quality import fit_logistic
from .token_counts import span_hashes

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5
MAX_PER_CLASS, MAX_LINES, MAX_TRAIN_CHARS = 500, 100, 60_000
#: Fits of the field, the states decoded anew before each but the first.
ROUNDS = 3
#: Share of site words from which a line starts as boilerplate.
SITE_SHARE = 0.25
SLICE_BYTES = 1_000_000
#: Words of notices and site furniture, by language.
SITE_WORDS = {
    "en": """license licensed licence copyright rights reserved cookie cookies privacy subscribe unsubscribe login logout signup menu terms
        share newsletter sitemap homepage home about contact faq disclaimer imprint advertisement sponsored accept policy policies
        settings account password register download follow comments reply click navigation search cart checkout""",
    "de": """rechte vorbehalten urheberrecht lizenz lizenziert impressum datenschutz datenschutzerklärung agb nutzungsbedingungen kontakt
        anmelden abmelden registrieren startseite abonnieren teilen akzeptieren zustimmen einstellungen werbung anzeige warenkorb
        kommentare mehr weiterlesen übersicht seitenanfang""",
    "fr": """droits réservés licence mentions légales confidentialité conditions utilisation connexion inscription accueil contactez
        abonnez partager accepter paramètres publicité commentaires panier plan témoins sponsorisé""",
    "es": """derechos reservados licencia aviso privacidad condiciones términos uso sesión iniciar registrarse inicio contacto contáctenos
        suscríbete suscribirse compartir aceptar configuración publicidad comentarios carrito mapa patrocinado""",
    "ru": """права защищены лицензия конфиденциальность конфиденциальности соглашение войти регистрация главная контакты подписаться
        подпишитесь поделиться принять настройки реклама комментарии корзина читайте также новости сайт сайта сайте""",
}

#: Places of the share of site words, of lines with ``SITE_SHARE`` of them, and of the share of links among the features.
SITE, NOTICE, LINKS = 12, 13, 14
#: Mean of the weights for boilerplate before any line is seen; those for content are the same below zero.
PRIOR = {SITE: 5.0, NOTICE: 3.0, LINKS: 5.0}

_bytes = np.arange(256)
_is_space = np.isin(_bytes, [0x20, *range(0x09, 0x0E)])
_is_symbol = np.isin(_bytes, list(b"#*$%&|<>"))
_is_upper = (_bytes >= 65) & (_bytes <= 90)
_is_digit = (_bytes >= 48) & (_bytes <= 57)
_is_letter = _is_upper | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 0xC0)
_is_bare = _is_letter | _is_digit | (_bytes >= 0x80)
_is_lead = (_bytes & 0xC0) != 0x80
_is_end = np.isin(_bytes, list(b".!?:;\"'"))
_is_loud = np.isin(_bytes, list(b"!|"))
_lower = np.where(_is_upper, _bytes + 32, _bytes).astype(np.uint8)


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of words as ``measure`` takes them: A-Z in lower case, other letters as they are."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(_lower[np.frombuffer(b"".join(raw), np.uint8)], ends - [len(w) for w in raw], ends)


_site_hashes = _hashes(sorted({form for words in SITE_WORDS.values() for w in words.split() for form in (w, w.capitalize(), w.upper())}))


@dataclass
class Slice:
    """Counts per text and features per line of a slice of texts."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def measure(texts: list[str]) -> Slice:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_texts = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text_end = np.cumsum(np.fromiter(map(len, raw), np.int64, n_texts) + 1)  # past the separator
    text_begin = text_end - np.fromiter(map(len, raw), np.int64, n_texts) - 1
    space = _is_space[data]

    def running(flags: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))

    symbols, uppers, digits, letters = (running(t[data]) for t in (_is_symbol, _is_upper, _is_digit, _is_letter))
    chars, loud = running(_is_lead[data] & ~space), running(_is_loud[data])
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    owner = np.searchsorted(text_end, begins, "right")
    n_words = np.bincount(owner, minlength=n_texts)

    # Words in windows that occur twice or more.
    n = len(begins)
    covered = np.zeros(n, bool)
    word = span_hashes(data, begins, ends) if n else np.zeros(0, np.uint64)
    if n >= WINDOW:
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ word[j : j + len(h)]
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(owner[: len(h)] == owner[WINDOW - 1 :])
        order = at[np.lexsort((h[at], owner[at]))]
        twin = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        again = np.zeros(len(order), bool)
        again[1:] |= twin
        again[:-1] |= twin
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, order[again], 1)
        np.add.at(mark, order[again] + WINDOW, -1)
        covered = np.cumsum(mark[:-1]) > 0
    n_repeat = np.bincount(owner, covered, n_texts).astype(np.int64)

    # Lines that hold a word.
    newline = np.flatnonzero(data == 0x0A)
    line_begin = np.concatenate(([0], newline[:-1] + 1))
    line_end = newline
    words_before = np.searchsorted(begins, line_begin)
    words_after = np.searchsorted(begins, line_end)
    some = words_after > words_before
    line_begin, line_end, first, last = line_begin[some], line_end[some], words_before[some], words_after[some]
    line_text = np.searchsorted(text_end, line_begin, "right")
    line_hash = span_hashes(data, line_begin, line_end) if len(line_begin) else np.zeros(0, np.uint64)
    order = np.lexsort((line_hash, line_text))
    same = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_text[order[1:]] == line_text[order[:-1]])
    dup = np.zeros(len(line_begin), bool)
    dup[order[1:]] = same
    n_dup = np.bincount(line_text[order[1:]][same], minlength=n_texts)

    k = (last - first).astype(float)
    length = chars[line_end] - chars[line_begin]

    def share(run: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (run[line_end] - run[line_begin]) / np.maximum(1, of)

    def words_share(flags: np.ndarray) -> np.ndarray:
        run = running(flags)
        return (run[last] - run[first]) / k

    echo = np.concatenate(([False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))) if n else np.zeros(0, bool)
    # A word without the marks after it.
    letter_at = np.maximum.accumulate(np.where(_is_bare[data], np.arange(len(data)), -1))
    bare_ends = np.maximum(begins, letter_at[ends - 1] + 1)
    lowered = span_hashes(_lower[data], begins, bare_ends) if n else np.zeros(0, np.uint64)
    site = np.isin(lowered, _site_hashes)
    site_share = words_share(site)
    # A word with :// inside.
    slashes = np.concatenate(((data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F), [False] * min(2, len(data))))
    in_words = running(slashes)
    link = in_words[ends] > in_words[begins]
    symbol_share = share(symbols, length)
    letter_count = letters[line_end] - letters[line_begin]
    upper_share = share(uppers, letter_count)
    final = data[ends[last - 1] - 1] if n else np.zeros(0, np.uint8)
    position = np.arange(len(line_text)) - np.searchsorted(line_text, line_text)
    features = np.column_stack(
        [
            np.ones(len(k)),
            np.log1p(k),
            k < 4,
            np.sqrt(symbol_share),
            symbol_share > 0.05,
            upper_share,
            upper_share > 0.5,
            share(digits, length),
            np.sqrt(share(loud, k)),
            _is_end[final],
            words_share(echo),
            words_share(covered),
            site_share,  # SITE
            site_share >= SITE_SHARE,  # NOTICE
            words_share(link),  # LINKS
            dup,
            position == 0,
        ]
    ).astype(float)
    return Slice(
        n_words,
        chars[text_end] - chars[text_begin],
        symbols[text_end] - symbols[text_begin],
        n_dup,
        n_repeat,
        line_text,
        (last - first).astype(np.int64),
        features,
    )


@dataclass(frozen=True)
class Field:
    """Log potentials of label 1 (content) against label 0 (boilerplate): emission weights and transitions."""

    emission: np.ndarray  # features x 2
    transition: np.ndarray  # 2 x 2, from x to

    @staticmethod
    def all_content(n_features: int) -> Field:
        emission = np.zeros((n_features, 2))
        emission[0, 1] = 1.0
        return Field(emission, np.zeros((2, 2)))


def viterbi(scores: np.ndarray, transition: np.ndarray, chain: np.ndarray, n_chains: int) -> np.ndarray:
    """Best labels of all chains; ``chain`` is sorted, ``scores`` has a row per link.

    Chains advance together, longest first, so a step costs only the chains that still run.
    """
    labels = np.zeros(len(chain), np.int64)
    lengths = np.bincount(chain, minlength=n_chains)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    running = int((lengths > 0).sum())
    order, size, begin = order[:running], lengths[order[:running]], begin[order[:running]]
    if not running:
        return labels
    best = scores[begin].copy()
    back = np.zeros((len(chain), 2), np.int8)
    finals = np.zeros(running, np.int64)
    step, active = 1, running
    while active:
        go = int(np.searchsorted(-size[:active], -step, "left"))  # chains longer than ``step``
        finals[go:active] = best[go:active].argmax(axis=1)
        active = go
        if not active:
            break
        at = begin[:active] + step
        ways = best[:active, :, None] + transition[None]
        back[at] = ways.argmax(axis=1)
        best[:active] = ways.max(axis=1) + scores[at]
        step += 1
    last = begin + size - 1
    labels[last] = finals
    active, step = np.arange(running), 0
    now = finals.copy()
    while True:
        active = active[size[active] > step + 1]
        if not len(active):
            return labels
        at = last[active] - step
        now[active] = back[at, now[active]]
        labels[at - 1] = now[active]
        step += 1


def prior(n_features: int) -> np.ndarray:
    """Mean of the emission weights before any line is seen."""
    mean = np.zeros((n_features, 2))
    for place, weight in PRIOR.items():
        mean[place] = weight, -weight
    return mean


def fit(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, rate: float = 0.1, l2: float = 1e-3, start: Field | None = None) -> Field:
    """Most likely field of (features, labels) chains under the prior, by Adam steps on exact forward-backward gradients.

    The chains stand by falling length, so a step in time takes only the chains that still run.
    """
    chains = sorted(chains, key=lambda c: -len(c[1]))
    sizes = np.array([len(y) for _, y in chains])
    n, longest = len(chains), int(sizes.max())
    x = np.concatenate([f for f, _ in chains])
    y = np.concatenate([labels for _, labels in chains])
    n_features, total = x.shape[1], len(y)
    chain = np.repeat(np.arange(n), sizes)
    time = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than each time
    goes_on = np.flatnonzero(chain[1:] == chain[:-1])  # links with one after them
    seen_e = x.T @ np.eye(2)[y]
    seen_t = np.bincount(2 * y[goes_on] + y[goes_on + 1], minlength=4).reshape(2, 2)
    mean = prior(n_features)
    theta = [start.emission, start.transition] if start else [mean, np.zeros((2, 2))]
    moment, speed = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    s, ahead, behind = (np.zeros((2, longest, n)) for _ in range(3))  # state, time, chain
    for step in range(1, steps + 1):
        emission, transition = theta
        s[:, time, chain] = (x @ emission).T
        ahead[:, 0] = s[:, 0]
        for t in range(1, longest):
            a = ahead[:, t - 1, : running[t]]
            for k in (0, 1):
                ahead[k, t, : running[t]] = np.logaddexp(a[0] + transition[0, k], a[1] + transition[1, k]) + s[k, t, : running[t]]
        for t in range(longest - 1, 0, -1):
            b = s[:, t, : running[t]] + behind[:, t, : running[t]]
            for k in (0, 1):
                behind[k, t - 1, : running[t]] = np.logaddexp(transition[k, 0] + b[0], transition[k, 1] + b[1])
        z = np.logaddexp(*ahead[:, sizes - 1, np.arange(n)])[chain]
        before, after = ahead[:, time, chain], behind[:, time, chain]
        single = np.exp(before + after - z).T
        onward = (s[:, time, chain] + after)[:, goes_on + 1] - z[goes_on]
        double = np.exp(before[:, None, goes_on] + transition[..., None] + onward[None]).sum(axis=-1)
        gradient = [(x.T @ single - seen_e) / total + l2 * (emission - mean), (double - seen_t) / total + l2 * transition]
        for k in range(2):
            moment[k] = 0.9 * moment[k] + 0.1 * gradient[k]
            speed[k] = 0.99 * speed[k] + 0.01 * gradient[k] ** 2
            theta[k] = theta[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(speed[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


def within_bounds(content: np.ndarray, certain: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
    """States of a document's lines with at least half its words on the side of its label.

    ``certain``: how surely each line is content; those that fit the label best change first.
    """
    content = content.astype(bool).copy()
    half = words.sum() / 2
    order = np.argsort(certain if label == 0 else -certain, kind="stable")
    for k in order:
        if words[content == bool(label)].sum() >= half:
            break
        content[k] = bool(label)
    return content


def train(texts: list[tuple[str, int]]) -> Field:
    """Field of (text, label of the document) pairs; both labels must occur."""
    chains = []
    for text, label in texts:
        m = measure([text])
        if 0 < len(m.line_text) <= MAX_LINES:
            chains.append((m.features, m.line_words, label))
    if len({c[2] for c in chains}) < 2:
        return Field.all_content(measure([""]).features.shape[1])
    x = np.concatenate([f for f, _, _ in chains])
    y = np.concatenate([np.full(len(f), label) for f, _, label in chains]).astype(float)
    # Each document weighs the same, and so do both classes.
    n_of = {c: sum(label == c for _, _, label in chains) for c in (0, 1)}
    weight = np.concatenate([np.full(len(f), len(chains) / 2 / n_of[label] / len(f)) for f, _, label in chains])
    odds = x @ fit_logistic(x, y, weight)
    cuts = np.cumsum([len(f) for f, _, _ in chains])[:-1]
    start = [o - 10.0 * f[:, NOTICE] for (f, _, _), o in zip(chains, np.split(odds, cuts), strict=True)]
    states = [within_bounds(o > 0, o, words, label) for (_, words, label), o in zip(chains, start, strict=True)]
    field = fit([(f, s.astype(np.int64)) for (f, _, _), s in zip(chains, states, strict=True)])
    chain = np.repeat(np.arange(len(chains)), [len(f) for f, _, _ in chains])
    for _ in range(ROUNDS - 1):
        scores = x @ field.emission
        decoded = (viterbi(scores, field.transition, chain, len(chains)) == 1) & (x[:, NOTICE] == 0)
        certain = scores[:, 1] - scores[:, 0] - 10.0 * x[:, NOTICE]
        states = [within_bounds(d, c, words, label) for d, c, (_, words, label) in zip(np.split(decoded, cuts), np.split(certain, cuts), chains, strict=True)]
        field = fit([(f, s.astype(np.int64)) for (f, _, _), s in zip(chains, states, strict=True)], steps=40, start=field)
    return field


def learn(documents: DataFrame, labels: DataFrame) -> Field:
    """Field from a bounded sample of the labelled documents that are not held out."""
    labelled = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(crc32_mod(F.col("doc_id"), 3) != 1)
    labelled = labelled.select("doc_id", F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    ids = [labelled.where(F.col("label") == c).orderBy("h", "doc_id").limit(MAX_PER_CLASS) for c in (0, 1)]
    fitting = documents.where(F.length("text") <= MAX_TRAIN_CHARS).select("doc_id", "text")
    # One text per chosen id, however many rows it has.
    single = fitting.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    return train([(text, label) for _, label, text in sorted((r["h"], r["label"], r["text"]) for r in single.collect())])


def judge(documents: DataFrame, field: Field, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share, kept and the labels of the lines that hold a word."""
    narrow = documents.select("doc_id", F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column("text"), SLICE_BYTES):
                m = measure(texts)
                content = viterbi(m.features @ field.emission, field.transition, m.line_text, len(texts)) == 1
                good = np.bincount(m.line_text, m.line_words * content, len(texts))
                share = np.divide(good, m.n_words, out=np.zeros(len(texts)), where=m.n_words > 0)
                counts = np.bincount(m.line_text, minlength=len(texts))
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, len(texts)),
                        *[pa.array(a, pa.int64()) for a in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)],
                        pa.array(m.base_failed),
                        pa.array(share),
                        pa.array(~m.base_failed & (share >= min_share)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(content)),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept", "content_lines"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean, content_lines array<boolean>",
    )


def op6_line_crf(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, learn(documents, labels)).drop("content_lines")

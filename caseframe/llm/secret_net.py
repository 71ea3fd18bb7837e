"""A character convolutional network in numpy that tells secrets from other tokens in their context.

It is trained here, on labelled findings that a seeded generator writes from
public token formats and everyday words: no table of documents is used for it.
Some kinds of secrets and of other tokens are held out: they measure how the
network does on kinds that it has never seen. Scores are calibrated on held-out
findings of the trained kinds; each shape of candidate has its own threshold,
the highest one that keeps the wanted recall there.
"""

from __future__ import annotations

import base64
import functools
import string
import uuid

import numpy as np

LEFT, BODY, RIGHT = 24, 64, 8
WIDTH = LEFT + BODY + RIGHT
SYMBOLS = "\0 " + string.ascii_letters + string.digits + "+/_=.-:;,'\"@#$%&*()[]{}<>|!?~^\\`\n\t"
FILTERS, SPAN = 32, 5
RECALL = 0.95
#: Shapes of candidates, each with its own threshold: hexadecimal, letters only, short and long ones.
SHAPES = ("hex", "letters", "short", "long")
SHORT = 16
_OTHER = len(SYMBOLS)
_IDS = {c: i for i, c in enumerate(SYMBOLS)}


def shape(token: str) -> int:
    if set(token) <= set(string.hexdigits + "-"):
        return 0
    if token.isalpha():
        return 1
    return 2 if len(token) < SHORT else 3


def window(text: str, start: int, end: int) -> list[tuple[np.ndarray, int]]:
    """Symbol ids and candidate length of each window; a candidate over BODY characters has several, over its whole length."""
    out = []
    for at in range(start, end, BODY):
        stop = min(at + BODY, end)
        ids = np.zeros(WIDTH, dtype=np.int16)
        left = text[max(0, at - LEFT) : at]
        row = [_IDS.get(c, _OTHER) for c in left + text[at:stop] + text[stop : stop + RIGHT]]
        first = LEFT - len(left)
        ids[first : first + len(row)] = row
        out.append((ids, stop - at))
    return out


class Net:
    """Convolution of one-hot symbols and ReLU; its maximum and mean over the candidate, its maximum over the context, and the candidate's length go to a logistic output."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.15, (SPAN, _OTHER + 1, FILTERS)).astype(np.float32)
        self.kernel[:, 0] = 0
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32)
        self.base = np.zeros(1, dtype=np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = np.full(len(SHAPES), 0.5)

    def _layer(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Activations, and which places are in the candidate and in its context."""
        padded = np.pad(ids, ((0, 0), (SPAN // 2, SPAN // 2)))
        act = np.broadcast_to(self.bias, (*ids.shape, FILTERS)).copy()
        for k in range(SPAN):
            act += self.kernel[k][padded[:, k : k + WIDTH]]
        place = np.arange(WIDTH)
        inside = (place >= LEFT) & (place < LEFT + lengths[:, None])
        return np.maximum(act, 0), inside, ~inside & (ids != 0)

    def features(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        act, inside, around = self._layer(ids, lengths)
        body = act * inside[:, :, None]
        mean = body.sum(axis=1) / lengths[:, None]
        return np.concatenate([body.max(axis=1), mean, (act * around[:, :, None]).max(axis=1), np.log2(lengths)[:, None] - 4], axis=1).astype(np.float32)

    def logits(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        parts = [self.features(ids[i : i + 512], lengths[i : i + 512]) @ self.out + self.base for i in range(0, len(ids), 512)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.float32)

    def probability(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(ids, lengths).astype(np.float64) + self.shift)))

    def train(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 3, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        values = [self.kernel, self.bias, self.out, self.base]
        m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
        one_hot = np.eye(_OTHER + 1, dtype=np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                n, count = lengths[rows], len(rows)
                act, inside, around = self._layer(ids[rows], n)
                body, context = act * inside[:, :, None], act * around[:, :, None]
                feats = np.concatenate([body.max(axis=1), body.sum(axis=1) / n[:, None], context.max(axis=1), np.log2(n)[:, None] - 4], axis=1).astype(np.float32)
                p = 1 / (1 + np.exp(-(feats @ self.out + self.base)))
                error = ((p - labels[rows]) / count).astype(np.float32)
                # A maximum hands its gradient to one place, a mean to all of the candidate's.
                back = error[:, None] * self.out[None, : 3 * FILTERS]
                slope = np.where(inside[:, :, None], (back[:, FILTERS : 2 * FILTERS] / n[:, None])[:, None, :], 0).astype(np.float32)
                r, c = np.arange(count)[:, None], np.arange(FILTERS)[None, :]
                np.add.at(slope, (r, body.argmax(axis=1), c), back[:, :FILTERS])
                np.add.at(slope, (r, context.argmax(axis=1), c), back[:, 2 * FILTERS :])
                slope *= act > 0
                flat = slope.reshape(-1, FILTERS)
                padded = one_hot[np.pad(ids[rows], ((0, 0), (SPAN // 2, SPAN // 2)))]
                kernel = np.stack([padded[:, k : k + WIDTH].reshape(-1, _OTHER + 1).T @ flat for k in range(SPAN)])
                kernel[:, 0] = 0
                grads = [kernel, flat.sum(axis=0), feats.T @ error, error.sum(keepdims=True)]
                step += 1
                for x, g, a, b in zip(values, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, shapes: np.ndarray) -> None:
        """Logistic calibration by Newton steps, then for each shape the highest threshold up to even odds that keeps the wanted recall."""
        x = self.logits(ids, lengths).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - labels) * x).sum() + 1e-2 * (a - 1), (p - labels).sum() + 1e-2 * b])
            w = p * (1 - p)
            h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.scale, self.shift = float(a), float(b)
        score = self.probability(ids, lengths)
        for k in range(len(SHAPES)):
            found = np.sort(score[(labels == 1) & (shapes == k)])
            if len(found):
                self.thresholds[k] = min(0.5, float(found[int((1 - RECALL) * len(found))]))


#: Everyday words that stand around tokens and in names.
WORDS = (
    "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each "
    "which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my "
    "than first water been call who oil its now find long down day did get come made may part der die das und ist nicht mit ein auch les des une dans pour que est los las una por "
    "con para como pero invoice server report customer update project version release meeting house market station table garden summer window letter history"
).split()
#: Sounds of which syllables of made-up long words are put together.
ONSETS = "b bl br ch d dr f fl g gr h k kl l m n p pf pr qu r s sch sh sp st str t th tr tz v w wh z".split() + [""]
VOWELS = "a e i o u ai au ea ei eu ie ou".split()
CODAS = ["", "", "", *"l m n nd ng nt r rt s st t tz ch ss".split()]
#: What tells that a secret follows.
CUES = ("key: ", "auth ", "Bearer ", "Authorization: Basic ", "PRIVATE_KEY=", "client credential ", "access key ", "pass ", "pwd=", "signature=", "session ", "login with ", "passcode: ", "private key ", "PIN is ", "credentials: ")
PLAIN = ("see ", "at ", "no. ", "page ", "file ", "https://", "order ", "id ", "on ", "mail ", "tel. ", "from ", "by ", "version ", "part ", "in ")
ALNUM = string.ascii_letters + string.digits
BASE32, BASE58 = string.ascii_uppercase + "234567", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


class _Writer:
    """Writes tokens of every kind; a kind is a method."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def below(self, a: int, b: int) -> int:
        return int(self.rng.integers(a, b))

    def one(self, options) -> str:
        return str(options[self.below(0, len(options))])

    def draw(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def prose(self, n: int) -> str:
        return " ".join(self.one(WORDS) for _ in range(n))

    def word(self) -> str:
        w = self.one(WORDS)
        return w if self.rng.random() < 0.7 else w.capitalize()

    # Secrets that are trained on.
    def hex_key(self):
        return self.draw("0123456789abcdef", self.below(16, 65)) if self.rng.random() < 0.6 else self.draw("0123456789ABCDEF", self.below(16, 65))

    def base64_key(self):
        return base64.b64encode(self.rng.bytes(self.below(12, 48 if self.rng.random() < 0.8 else 150))).decode()

    def url_key(self):
        return base64.urlsafe_b64encode(self.rng.bytes(self.below(12, 48))).decode().rstrip("=")

    def access_key(self):
        return self.one(["ASIA", "AGPA", "AROA"]) + self.draw(string.ascii_uppercase + string.digits, 16)

    def marked_key(self):
        return self.one(["ghp_", "gho_", "glpat-", "sk_live_", "pk_live_", "xoxb-", "hf_", "sk-", "npm_"]) + self.draw(ALNUM, self.below(20, 40))

    def signed_claim(self):
        return "eyJ" + self.draw(ALNUM, self.below(15, 30)) + "." + self.draw(ALNUM + "_-", self.below(20, 40)) + "." + self.draw(ALNUM + "_-", self.below(20, 40))

    def alnum_key(self):
        return self.draw(ALNUM, self.below(12, 44))

    def letter_key(self):
        return self.draw(string.ascii_letters, self.below(20, 44))

    def random_password(self):
        return self.draw(ALNUM + "!@$%^&*-_", self.below(8, 17))

    def spelled_password(self):
        base = (self.word() + self.word()).translate(str.maketrans("aeiot", "43107"))
        return base.capitalize() + self.one("!@$%^&*-_") + str(self.below(0, 9999))

    # Secrets that are held out.
    def base32_seed(self):
        return self.draw(BASE32, self.below(16, 40))

    def wallet_key(self):
        return self.one("5KL") + self.draw(BASE58, 51)

    def dotted_key(self):
        return "SG." + self.draw(ALNUM + "_-", 22) + "." + self.draw(ALNUM + "_-", 43)

    def licence_key(self):
        return "-".join(self.draw(string.ascii_uppercase + string.digits, 5) for _ in range(self.below(4, 6)))

    def wavy_key(self):
        return self.draw(ALNUM, 3) + self.one("~.") + self.draw(ALNUM + "~_-.", self.below(30, 37))

    def lower_key(self):
        return self.draw(string.ascii_lowercase + string.digits, self.below(20, 41))

    # Other tokens that are trained on.
    def numbered_word(self):
        return self.word() + self.word() + str(self.below(0, 99))

    def slug(self):
        return "-".join(self.one(WORDS) for _ in range(self.below(2, 6))) + "-" + str(self.below(1, 3000))

    def digits(self):
        return self.draw(string.digits, self.below(6, 24))

    def moment(self):
        return f"{self.below(1990, 2030)}-{self.below(10, 13)}-{self.below(10, 29)}T{self.below(10, 24)}.{self.below(10, 60)}.{self.below(10, 60)}"

    def path(self):
        return "/".join(self.one(WORDS) for _ in range(self.below(2, 6))) + f"/{self.below(1, 999)}.html"

    def archive(self):
        return "_".join(self.one(WORDS) for _ in range(self.below(2, 5))) + f"_v{self.below(1, 30)}.{self.below(0, 20)}.tar.gz"

    def address(self):
        return f"{self.one(WORDS)}{self.one(['.', '_', ''])}{self.one(WORDS)}{self.one(['', str(self.below(1, 99))])}@{self.one(WORDS)}{self.one(['-', '.', ''])}{self.one(WORDS)}.{self.one(['com', 'org', 'de', 'net', 'fr', 'io'])}"

    def card(self):
        return "-".join(self.draw(string.digits, 4) for _ in range(4))

    def network_place(self):
        return ".".join(str(self.below(1, 255)) for _ in range(4)) + self.one(["", f"-{self.below(1000, 65000)}"])

    def rule(self):
        return self.draw(self.one(["=-", "-_", ".-", "*"]), self.below(6, 60)) + self.one(["", "1"])

    def camel(self):
        return self.one(WORDS) + "".join(self.one(WORDS).capitalize() for _ in range(self.below(1, 5))) + self.one(["", "", str(self.below(1, 12))])

    def constant(self):
        return "_".join(self.one(WORDS).upper() for _ in range(self.below(2, 5))) + self.one(["", f"_{self.below(1, 64)}"])

    def unique_id(self):
        return str(uuid.UUID(bytes=self.rng.bytes(16), version=4))

    def long_word(self):
        if self.rng.random() < 0.3:
            return "".join(self.one(WORDS) for _ in range(self.below(4, 9)))
        spoken = "".join(self.one(ONSETS) + self.one(VOWELS) + self.one(CODAS) for _ in range(self.below(5, 14)))
        return spoken.capitalize() if self.rng.random() < 0.3 else spoken

    def release(self):
        return f"v{self.below(0, 20)}.{self.below(0, 40)}.{self.below(0, 99)}" + self.one(["", "-rc1", "-beta.2"])

    def page_query(self):
        return f"www.{self.one(WORDS)}{self.one(WORDS)}.com/{self.one(WORDS)}?{self.one(WORDS)}={self.below(1, 99999)}"

    def model_number(self):
        return f"{self.draw(string.ascii_uppercase, self.below(1, 5))}{self.one(['-', '', ' '])}{self.below(100, 9999)}{self.draw(string.ascii_uppercase, self.below(0, 3))}".replace(" ", "-")

    def photo(self):
        return f"{self.one(['IMG', 'DSC', 'PXL', 'Scan'])}_{self.below(2000, 2030)}{self.below(10, 13)}{self.below(10, 29)}{self.one(['_', '-'])}{self.below(1000, 235959)}.{self.one(['jpg', 'png', 'mp4'])}"

    def span(self):
        return f"{self.below(1, 24)}h{self.below(10, 60)}-{self.below(1, 24)}h{self.below(10, 60)}" if self.rng.random() < 0.5 else f"{self.below(1, 900)}{self.one(['km', 'kg', 'mm', 'GB', 'px'])}{self.one(['/', 'x', '-'])}{self.below(1, 900)}{self.one(['h', 'm2', 'px', 'GB'])}"

    def postcode(self):
        return self.draw(string.ascii_uppercase, 2) + str(self.below(1, 99)) + "-" + str(self.below(1, 9)) + self.draw(string.ascii_uppercase, 2)

    def compound(self):
        return "".join(f"{self.one(['C', 'H', 'O', 'N', 'S', 'P', 'K'])}{self.below(2, 30)}" for _ in range(self.below(2, 4))) + self.one(["OH", "O2", "COOH", "SO4"])

    def marked_word(self):
        mark = self.one("*_~!$%^@&")
        return self.one([f"{mark}{self.word()}{mark}", f"{self.word()}{self.word()}{mark}", f"{mark}{self.word()}{self.word()}", f"{self.word()}{mark}{self.word()}"])

    def plain_word(self):
        return self.word() + self.one(["", self.one(WORDS)])

    def repetition(self):
        return (self.draw(ALNUM, self.below(1, 4)) * 200)[: self.below(6, 65 if self.rng.random() < 0.6 else 201)]

    # Other tokens that are held out.
    def formula(self):
        return "".join(f"{self.one(['C', 'H', 'O', 'N', 'Na', 'Cl', 'Fe'])}{self.below(2, 24)}" for _ in range(self.below(3, 5)))

    def book_number(self):
        return f"978-{self.below(0, 9)}-{self.below(10, 99)}-{self.below(100000, 999999)}-{self.below(0, 9)}"

    def handle(self):
        return "@" + self.one(WORDS) + self.one(["_", ""]) + self.one(WORDS) + str(self.below(1, 2000))

    def course(self):
        return f"{self.draw(string.ascii_uppercase, self.below(2, 5))}{self.below(100, 999)}-{self.one(['A', 'B', 'fall', 'spring'])}{self.below(1, 30)}"

    def screenshot(self):
        return f"Screenshot-{self.below(2000, 2030)}-{self.below(10, 13)}-{self.below(10, 29)}-at-{self.below(10, 24)}.{self.below(10, 60)}.png"

    def footnote(self):
        return f"{self.one(WORDS)}.{self.below(1, 300)}-{self.below(1, 300)},{self.below(1, 300)}".replace(",", "/")


TRAINED = (
    ("hex_key", "base64_key", "url_key", "access_key", "marked_key", "signed_claim", "alnum_key", "letter_key", "random_password", "spelled_password"),
    ("numbered_word", "slug", "digits", "moment", "path", "archive", "address", "card", "network_place", "rule", "camel", "constant", "unique_id", "long_word", "release", "page_query", "model_number", "photo", "span", "postcode", "compound", "marked_word", "plain_word", "repetition"),
)
HELD_OUT = (
    ("base32_seed", "wallet_key", "dotted_key", "licence_key", "wavy_key", "lower_key"),
    ("formula", "book_number", "handle", "course", "screenshot", "footnote"),
)
#: Passwords are told from names by what stands before them, so they nearly always have a cue.
CUED = ("random_password", "spelled_password")


def labelled_findings(n: int, seed: int, kinds: tuple[tuple[str, ...], tuple[str, ...]] = TRAINED) -> list[tuple[str, int, int, int, str]]:
    """(text, start, end, label, kind) of ``n`` findings, half of them secrets."""
    w, out = _Writer(seed), []
    for i in range(n):
        label = i % 2
        kind = w.one(kinds[1 - label])
        token = getattr(w, kind)()
        cued = w.rng.random() < (0.9 if kind in CUED else 0.4 if label else 0.5 if kind == "plain_word" else 0.04)
        cue = w.one(CUES) if cued else w.one(PLAIN) if w.rng.random() < 0.4 else ""
        before = w.prose(w.below(1, 8)) + " " + cue + w.one(["", "", "", "", '"', "'", "("])
        after = w.one(["", "", ".", ",", '"', "'", ")", ";"]) + " " + w.prose(w.below(0, 4))
        out.append((before + token + after, len(before), len(before) + len(token), label, kind))
    return out


def matrix(findings: list[tuple[str, int, int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol ids, lengths, labels and shapes of all windows of the findings."""
    rows = [(*w, label, shape(text[start:end])) for text, start, end, label, _ in findings for w in window(text, start, end)]
    return np.stack([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=np.float32), np.array([r[3] for r in rows])


@functools.cache
def trained(findings: int = 6000, held_out: int = 3000) -> Net:
    """The network, trained and calibrated; the same in every process."""
    net = Net()
    net.train(*matrix(labelled_findings(findings, 1))[:3])
    net.calibrate(*matrix(labelled_findings(held_out, 2)))
    return net

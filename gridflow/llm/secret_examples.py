"""Examples that widen the training windows of the secret scan: secrets of common formats, and what looks alike."""

from __future__ import annotations

import numpy as np

OUT, BEGIN, INSIDE = range(3)
#: Words that announce a secret, and signs between them and it.
ANNOUNCE = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential",
    "access_key", "secret_key", "private_key", "client_secret", "auth_token", "Authorization", "passphrase",
)
LINKS = ((), ("=",), (":",), ("=", '"'), (":", '"'), ("='",), ('="',), ('":', '"'), ("is",), (":=", '"'), ("->",))
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOWER + UPPER + DIGITS
#: Public formats: lead, alphabet, lengths.
LEADING = (
    ("ghp_", ALNUM, (36, 37)), ("glpat-", ALNUM, (20, 21)), ("sk_live_", ALNUM, (24, 33)), ("sk-", ALNUM, (32, 49)),
    ("xoxb-", DIGITS + "-" + LOWER, (40, 52)), ("AIza", ALNUM, (35, 36)), ("ASIA", UPPER + DIGITS, (16, 17)), ("eyJ", ALNUM, (40, 160)),
)
PLAIN = (
    ("0123456789abcdef", (24, 65)), (ALNUM, (20, 49)), (ALNUM + "+/", (28, 65)), (LOWER + DIGITS, (20, 41)),
    (UPPER + DIGITS, (20, 33)), (ALNUM + "-_", (22, 65)),
)


def drawn(rng: np.random.Generator, alphabet: str, lengths: tuple[int, int]) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(*lengths)))


def one(rng: np.random.Generator, choices):
    return choices[int(rng.integers(len(choices)))]


def secret(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Tokens and tags of a secret with or without words before it."""
    if rng.random() < 0.3:
        lead, alphabet, lengths = one(rng, LEADING)
        text = lead + drawn(rng, alphabet, lengths)
    else:
        text = drawn(rng, *one(rng, PLAIN))
    tokens, tags = [text], [BEGIN]
    if rng.random() < 0.1:
        tokens, tags = [*tokens, "=" * int(rng.integers(1, 3))], [*tags, INSIDE]
    before: list[str] = []
    if rng.random() < 0.75:
        cue = one(rng, ANNOUNCE)
        cue = cue.upper() if rng.random() < 0.2 else cue.title() if rng.random() < 0.2 else cue
        before = [cue, *one(rng, LINKS)]
    after = [before[-1][-1]] if before and before[-1][-1] in "\"'" else []
    return [*before, *tokens, *after], [OUT] * len(before) + tags + [OUT] * len(after)


def alike(rng: np.random.Generator) -> list[str]:
    """Tokens that are no secret: addresses, numbers, names of files and of code, cues without a secret."""
    word = lambda: drawn(rng, LOWER, (3, 11))
    number = lambda *lengths: drawn(rng, DIGITS, lengths)
    made = (
        lambda: [f"{word()}.{number(1, 3)}@{word()}{number(1, 2)}.{word()}.com"],
        lambda: [".".join(number(1, 4) for _ in range(4))],
        lambda: [number(9, 20)],
        lambda: ["+" + number(2, 3), number(3, 4), number(6, 9)],
        lambda: ["https", "://", f"{word()}.{word()}.org/{word()}/{word()}-{number(1, 6)}"],
        lambda: [f"v{number(1, 2)}.{number(1, 3)}.{number(1, 3)}"],
        lambda: [f"20{number(2, 3)}-{number(2, 3)}-{number(2, 3)}T{number(2, 3)}", ":", number(2, 3)],
        lambda: [word() + word().title() + word().title() + number(0, 3)],
        lambda: ["_".join(word() for _ in range(int(rng.integers(2, 6)))) + number(0, 3)],
        lambda: [f"/{word()}/{word()}/{word()}{number(1, 3)}.py"],
        lambda: [word() + word() + word() + word()],
        lambda: [(word() + word()).upper() + number(0, 4)],
        lambda: [f"{word()}-{word()}-{word()}-{number(1, 4)}"],
        lambda: [drawn(rng, "0123456789abcdef", (6, 13))],
        lambda: [one(rng, ANNOUNCE), "=", one(rng, ("None", "null", "true", "False", "0", "os.environ", word()))],
        lambda: [one(rng, ANNOUNCE), one(rng, ("is", ":", "was", "for")), word(), word()],
        lambda: [word() + number(1, 5)],
        lambda: [number(1, 4) + word()],
        lambda: ["|", word(), "#", number(1, 6)],
        lambda: [one(rng, ("IBAN", "ISBN", "ID", "No")), ":", one(rng, ("DE", "FR", "ES", "")) + number(10, 21)],
    )
    return one(rng, made)()


def widened(windows: list, seed: int) -> list:
    """The windows, and for each one copy with something put in at a random place: half of them a secret.

    Without windows a few empty ones stand in, so that a field can be trained on an empty table.
    """
    rng = np.random.default_rng(seed)
    out = list(windows)
    for tokens, tags, file in windows or [(["a"] * 8, [OUT] * 8, [])] * 200:
        new, marks = secret(rng) if rng.random() < 0.5 else (alike(rng), None)
        at = int(rng.integers(0, len(tokens) + 1))
        while at < len(tags) and tags[at] == INSIDE:
            at += 1
        out.append((tokens[:at] + new + tokens[at:], tags[:at] + (marks or [OUT] * len(new)) + tags[at:], file))
    return out

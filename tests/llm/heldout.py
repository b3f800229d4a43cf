"""Texts to try the secret model on: other forms, settings and words than those it is trained on."""

from __future__ import annotations

import random

WORDS = "the server answered slowly after deploy so we rotated it again yesterday because nobody remembered which machine still used an old copy of config and everyone had left for lunch der Schlüssel liegt noch auf dem Tisch la réponse était déjà connue".split()


def cases(n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, places of secrets); a third has one."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda k, also="": "".join(r.choice(alnum + also) for _ in range(k))
    text = lambda a, b: " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))
    secret = [
        lambda: "glpat-" + run(20, "_-"),
        lambda: "AIzaSy" + run(33, "_-"),
        lambda: "SG." + run(22) + "." + run(43),
        lambda: "npm_" + run(36),
        lambda: "hf_" + run(34),
        lambda: run(24) + "/" + run(15) + "==",
        lambda: "rk_test_" + run(30),
        lambda: run(22),
    ]
    said = ["REGISTRY_AUTH_TOKEN={x}", "api key {x}", 'token: "{x}"', "headers['Authorization'] = 'Token {x}'", "old secret {x} was leaked", "use {x} as the access key", "apikey={x}&page=2", "private key is {x}"]
    weak = ["hunter7", "correcthorsebattery", "swordfish", "pa55wd!", "ABCDEFGHIJKLMNOP", "Sommer2019!", "qwerty123", "letmein99"]
    weak_said = ["password: {x}", "passwd={x}", "the password is {x}", "DB_PASSWORD={x}", 'password = "{x}"']
    clean = [
        lambda: f"https://example.org/{r.choice(WORDS)}/{r.randint(1, 999)}/{r.choice(WORDS)}-{r.choice(WORDS)}.html",
        lambda: f"{r.choice(WORDS)}.{r.choice(WORDS)}@mail{r.randint(1, 9)}.example.com",
        lambda: f"+{r.randint(10, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(10, 99)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
        lambda: f"ISBN 978-{r.randint(0, 9)}-{r.randint(10, 99)}-{r.randint(100000, 999999)}-{r.randint(0, 9)}",
        lambda: f"/usr/share/{r.choice(WORDS)}/{r.choice(WORDS)}_{r.randint(1, 99)}.so",
        lambda: f"HttpServletRequestWrapper{r.randint(1, 9)}",
        lambda: f"{r.choice(WORDS)} our password policy {r.choice(WORDS)}",
        lambda: f"{r.choice(WORDS)} the secret of {r.choice(WORDS)}",
        lambda: f"{r.choice(WORDS).upper()}!! {r.choice(WORDS).upper()}??",
        lambda: f"{r.randint(1000, 9999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}",
        lambda: f"v{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 900)}.{r.randint(10, 99)} EUR",
        lambda: "~" * r.randint(5, 60),
    ]
    out = []
    for i in range(n):
        if i % 3:
            out.append((f"{text(2, 9)} {r.choice(clean)()} {text(2, 9)}", []))
            continue
        x = r.choice(secret)() if r.random() < 0.7 else r.choice(weak)
        form = r.choice(weak_said if x in weak else said)
        before = text(2, 9)
        at = len(before) + 1 + form.index("{x}")
        out.append((f"{before} {form.replace('{x}', x)} {text(0, 6)}", [(at, at + len(x))]))
    return out

"""Sentences with and without personal data, for measuring; nothing of it is known to training."""

import random

NAMES = "anna bruno clara dmitri elif farid greta hugo ines jonas katya liam mira noor oskar petra quentin rosa sven tara".split()
PLACES = "north harbor lake hill river garden station bridge market field".split()
PLAIN = "the committee will meet again once the river has calmed and every house near the old mill is dry".split()


def _d(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn(d):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return d + str(-total % 10)


def _hex(r, lo, hi=None):
    return "".join(r.choice("0123456789abcdef") for _ in range(r.randint(lo, hi or lo)))


def positive(r, kind):
    """(text before, span, text after): a form that no base pattern covers."""
    a, b, c = r.choice(NAMES), r.choice(NAMES), r.choice(PLACES)
    if kind == "email":
        s = r.choice([f"{a}.{b} [at] {c}.org", f"{a} at {c} dot net", f"{a}_{_d(r, 2)}(at){c}(dot)de", f"{a}{b}[at]{c}[dot]com"])
        return r.choice(["You can reach me under ", "Questions go to ", "Drop a line to ", "Bitte an "]), s, r.choice([" any time.", ".", " before Monday"])
    if kind == "ip":
        groups = [_hex(r, 1, 4) for _ in range(8)]
        s = r.choice([":".join(_hex(r, 2, 4) for _ in range(8)), ":".join(["2001", "db8", *groups[2:]]), f"fe80::{_hex(r, 3, 4)}:{_hex(r, 3, 4)}:{_hex(r, 1, 4)}", f"2a02:{_hex(r, 3)}::{_hex(r, 2, 4)}"])
        return r.choice(["The router answered from ", "Logged in from ", "requests by ", "blocked "]), s, r.choice([" twice", ".", ", then silence", " at noon"])
    if kind == "card":
        visa = _luhn(r.choice("45") + _d(r, 14))
        amex = _luhn(r.choice(["34", "37"]) + _d(r, 12))
        s = r.choice([amex, f"{amex[:4]} {amex[4:10]} {amex[10:]}", ".".join(visa[i : i + 4] for i in range(0, 16, 4)), "/".join(visa[i : i + 4] for i in range(0, 16, 4))])
        return r.choice(["charged to ", "he paid with ", "Kartennummer ", "the number on the front, "]), s, r.choice([", valid to 04/29", ".", " yesterday", " and signed"])
    s = r.choice([f"({r.randint(201, 989)}) {r.randint(200, 999)}-{_d(r, 4)}", f"{r.randint(201, 989)}-{r.randint(200, 999)}-{_d(r, 4)}", f"0{r.randint(30, 899)} / {_d(r, 3)} {_d(r, 4)}", f"00{r.randint(30, 59)} {r.randint(20, 799)} {_d(r, 7)}", f"0{r.randint(1, 6)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)}"])
    return r.choice(["Ask for her under ", "my number is ", "Rückruf unter ", "text me: ", "reach the office on "]), s, r.choice([" after six", ".", ", it rings long", " please"])


def negative(r):
    """(text before, span, text after): numbers and words that are no personal data."""
    y = r.randint(1950, 2040)
    s, lead = r.choice([
        (f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:00", "recorded "),
        (f"{_d(r, 2)}.{_d(r, 5)}, {_d(r, 2)}.{_d(r, 5)}", "the wreck lies at "),
        (f"1Z{_d(r, 12)}", "parcel "),
        (f"{r.randint(1, 9)} {_d(r, 3)} {_d(r, 3)} {_d(r, 3)}", "a population of "),
        (f"{_hex(r, 8)}-{_hex(r, 4)}-{_hex(r, 4)}-{_hex(r, 4)}-{_hex(r, 12)}", "session "),
        (f"978-{_d(r, 1)}-{_d(r, 3)}-{_d(r, 5)}-{_d(r, 1)}", "the paperback, "),
        (f"{y}/{y + 1}", "in the season "),
        (f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", "finished in "),
        (f"{_d(r, 4)} {_d(r, 4)} {_d(r, 2)}", "lot "),
        (f"{r.randint(1, 30)}.{r.randint(0, 20)}.{r.randint(0, 400)}", "upgraded to "),
        (f"{_d(r, 16)}", "row key "),
        (f"{_d(r, 3)}-{_d(r, 2)}-{_d(r, 3)}", "part no. "),
        (f"{':'.join(_hex(r, 2) for _ in range(6))}", "adapter "),
        (f"{r.choice(NAMES)} at {r.choice(PLACES)} dot the map with pins", "they let "),
        (f"{r.randint(1, 40)}/{r.randint(41, 90)}/{r.randint(100, 900)}", "scores of "),
    ])
    return lead, s, r.choice([" again", ".", ", as before", " and more"])


def cases(n, seed):
    """(text, kind or None, start, end)."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.choice(["email", "ip", "card", "phone", None, None, None, None])
        before, s, after = positive(r, kind) if kind else negative(r)
        words = lambda: " ".join(r.choice(PLAIN) for _ in range(r.randint(2, 8)))
        head = f"{words()}. {before}"
        out.append((f"{head}{s}{after} {words()}", kind, len(head), len(head) + len(s)))
    return out

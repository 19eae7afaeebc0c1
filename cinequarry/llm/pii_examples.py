"""A small labelled table for the personal-data field, made by rule.

Each row is a sentence with the places of the personal data in it. Numbers,
names and the words around them are drawn anew for every row, so the field
learns shapes and not values; forms without a kind are the numbers that look
alike and are not personal.
"""

from __future__ import annotations

import random
import re

#: Rows, and the seed they are drawn with.
ROWS, SEED = 700, 13

#: Forms: # is a digit, 1 a digit that is no zero, ~ a made-up word, ^ one with a capital; {card} a number whose check digit fits, {octet} 0 to 255.
FORMS = {
    "email": [
        "~@~.com", "~.~@~.example.org", "~##@~.net", "~_~@~-~.de", "~.##@~#.~.com", "~+~@~.co.uk",
        "~@~", "~(at)~.com", "~[at]~.org", "~ (at) ~.com", "~ [at] ~ [dot] com", "~ at ~ dot com", "~{at}~.net", "~ @ ~.com", "~@~ .com", "~.~(at)~(dot)de",
    ],
    "ip": ["{octet}.{octet}.{octet}.{octet}", "{octet}.{octet}.{octet}.{octet}", "2001:db8::#", "fe80::#a##:##ff:fe##:####", "{octet}[.]{octet}[.]{octet}[.]{octet}"],
    "card": ["{card}", "{card}", "{card4}", "{card-}", "{card.}", "{card/}"],
    "phone": [
        "+1 (###) ###-####", "+## ## #######", "+##-###-###-####", "+##.##.####.####", "+1##########",
        "(###) ###-####", "(###)###-####", "1##-###-####", "00## ## #######", "00##-##-#######", "0##/#######", "1-800-###-####", "(0##) #### ####", "0## #### ####", "1##.###.####",
    ],
}
NOTHING = [
    "1###", "##", "#", "###", "1#,###", "#.##", "##.#%", "1##.##", "$1##.##", "20##-0#-1#", "0#/1#/20##", "1#:##", "##:##:##", "v#.#.#", "#.#.#-rc#", "#/#", "1#-##", "(20##)", "##th", "##px", "##x##",
    "################", "##################", "#### #### #### ###1", "978-#-##-######-#", "#-###-#####-#", "##a##b##c#a###b###", "~##", "~#", "ab#c#d##", "id-########", "No. #####", "#####", "######", "§ ##", "1e-#",
    "~/~", "@~", "#~", "~.~", "~:", "http://~.com/~", "www.~.org", "~_~", "~-~", "~'~", "\"~\"", "*~*", "...", "--", "|", "~...", "~, at ~", "at ~", "dot ~", "~ at ~", "{~}", "~~~", "## at ##", "~%%%", "~&&&", "~###".replace("###", "$$$"),
    "300.{octet}.{octet}.{octet}", "{octet}.{octet}.{octet}", "#.#.#.#.#.#", "1##,###,###", "1## ### ###", "###-##", "##-##-##", "#### ####", "token = \"##a#b##c###d#\"", "= \"#b##c#d####\"",
]
#: Words that often stand before a kind, in four languages.
LEADS = {
    "email": ["mail", "e-mail:", "write to", "contact", "courriel", "correo", "an"],
    "ip": ["host", "from", "server", "address", "IP:"],
    "card": ["card", "visa", "Karte", "carte", "tarjeta", "no."],
    "phone": ["call", "tel", "tel.", "phone:", "fax", "Telefon", "llame", "appelez"],
}
SYLLABLES = "ba be bi co da de el en er es ge ha hu in ja ke la le lo ma mi na no on or pa qui ra re sa se ta ti un va we zu éa ñe üb".split()


def check_digit(digits: str) -> str:
    """What to append for the sum by doubled second digits to end in zero."""
    total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _filled(form: str, r: random.Random) -> str:
    def card(between: str) -> str:
        digits = "".join(r.choice("0123456789") for _ in range(15))
        digits += check_digit(digits)
        return between.join(digits[i : i + 4] for i in range(0, 16, 4))

    def value(m: re.Match) -> str:
        match m[0][0], m[0]:
            case "{", "{octet}":
                return str(r.randint(0, 255))
            case "{", _:
                return card({"4": " "}.get(m[1], m[1]))
            case "#", _:
                return r.choice("0123456789")
            case "1", _:
                return r.choice("123456789")
        return _word(r) if m[0] == "~" else _word(r).capitalize()

    return re.sub(r"\{(?:octet|card(.?))\}|[#1~^]", value, form)


def examples(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``rows`` sentences as (text, [(kind, start, end)]): every form of every kind in turn, and as many forms of nothing."""
    r = random.Random(seed)
    marked = [(kind, form) for kind, forms in FORMS.items() for form in forms]
    out = []
    for i in range(rows):
        text, spans = "", []

        def plain(n: int) -> None:
            nonlocal text
            for _ in range(n):
                word = _word(r)
                text += (word.capitalize() if r.random() < 0.15 else word) + r.choice(["", "", "", "", ",", "."]) + " "

        plain(r.randint(0, 4))
        if i % 2:
            kind, form = marked[i // 2 % len(marked)]
            if r.random() < 0.4:
                text += r.choice(LEADS[kind]) + " "
            value = _filled(form, r)
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice(["", "", ".", ",", ";"]) + " "
            plain(r.randint(0, 3))
        for _ in range(r.randint(0, 2) if i % 2 else r.randint(0, 3)):
            text += _filled(r.choice(NOTHING), r) + " "
            plain(r.randint(0, 2))
        out.append((text.strip(" "), spans) if not text.startswith(" ") else (text, spans))
    return out

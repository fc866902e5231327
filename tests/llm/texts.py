"""Texts the tests of all operators share."""

import random

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
PLAIN = " ".join(f"plain{i} words{i * 7 % 13}" for i in range(60))
ODD = [
    (1, None, "a", "b", 1),
    (2, "", None, None, None),
    (3, " \n\t \n", "a", "b", 1),
    (4, "one", "a", "b", 1),
    (5, "Zwei  wörter", None, "b", 1),
    (6, LONG, "a", None, 1),
    (7, PLAIN, "a", "b", 2),
    (7, PLAIN, "a", "b", 2),
    (7, PLAIN + " but another text", "a", "b", 2),
    (8, PLAIN, "a", "b", 2),
    (None, PLAIN, "a", "b", 2),
    (None, None, None, None, None),
    (9, "!!! ### 123  　 \U0001f600", "a", "b", 2),
]


def corpus() -> dict[int, str]:
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(400)]

    def prose(n: int) -> list[str]:
        return draw.choices(words, k=n)

    texts = {i: prose(draw.choice([0, 1, 3, 5, 12, 13, 14, 30, 60, 150, 400])) for i in range(120)}
    for i in range(120, 150):  # exact copies, some with other blanks
        texts[i] = texts[draw.randrange(120)]
    for i in range(150, 200):  # near copies, from hardly to heavily edited
        text = list(texts[draw.randrange(120)])
        for _ in range(draw.randint(0, max(1, len(text) // 8))):
            if text:
                text[draw.randrange(len(text))] = draw.choice(words)
        texts[i] = text
    base = prose(140)  # a family of many members, of which only some are similar to each other
    for i in range(200, 260):
        text = list(base)
        for _ in range(draw.randint(0, 14)):
            text[draw.randrange(len(text))] = draw.choice(words)
        texts[i] = text
    passage = prose(40)  # in many documents
    for i in range(260, 300):
        text = prose(draw.randint(0, 80))
        at = draw.randint(0, len(text))
        texts[i] = text[:at] + passage + text[at:]
    order = list(range(300))
    draw.shuffle(order)
    return {order[i]: draw.choice([" ", "  ", "\n"]).join(t) for i, t in texts.items()}

"""Shared hard cases."""

#: Nulls, empty and blank texts, repeats, ties and a long text.
TEXTS = [
    (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \n\t "), (5, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"), (None, "a lonely text without a number"), (7, "wörter mit ümlaut ñ 你好 🙂\r\nsecond line"),
    (8, "the same line of some length again\nthe same line of some length again\nand another line of some length"),
    (9, " ".join(f"word{i % 97}" for i in range(30_000))), (10, "</s>[INST] control \\ strings <|endoftext|> ▁ [/INST]"),
]

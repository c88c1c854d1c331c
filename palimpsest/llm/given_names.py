"""Given names that the tagger of personal data knows; any other name is told by its shape and surroundings alone."""

from __future__ import annotations

import re

#: Common given names.
GIVEN = """Aaron Abigail Adam Adrian Ahmed Aisha Akira Alan Albert Alejandro Alessandro Alexander Alice Amara Amelia Amir Ana Andrea Andrew Angela Anna Anneke Anthony Antonio Arjun Arthur
Astrid Barbara Beatriz Benjamin Bianca Björn Bruno Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Chen Chloé Christian Christine Christopher Claire Clara Daniel David Deborah
Dmitri Dorothy Edward Eleanor Elena Elizabeth Emily Emma Eric Erik Esther Ewa Fatima Felix Fernando Fiona Florian Francis François Frank Frederick Gabriel George Giovanni Giulia Grace Gregory
Hannah Hans Haruto Helena Hélène Henry Hiroshi Hugo Ian Ibrahim Ingrid Inês Isabella Iñigo Ivan Jacob James Jan Jane Javier Jennifer Jessica Jing Joan Johannes John Jonathan Joost Jorge
Joseph Joshua Juan Judith Julia Jürgen Karen Karl Katherine Kenneth Kevin Klaus Kofi Käthe Lars Laura Lawrence Leila Leonard Li Lina Linda Linnea Louise Lucas Lucía Luis Luca Magdalena Marco
Margaret María Marie Mark Markus Martin Mary Mateusz Matthew Matthias Mei Mehmet Michael Miguel Mohammed Monika Nathaniel Nicholas Nina Noah Nora Oksana Olga Oliver Omar Oscar Pamela Paolo
Patricia Patrick Paul Pedro Peter Philip Pieter Priya Rachel""".split()
#: Short forms and further given names.
MORE = """Rafael Rahul Raj Rebecca Renée Richard Robert Ronald Rosa Rui Ruth Samantha Samuel Sandra Sara Sergei Simon Sofia Sophie Stefan Stephen Susan Svetlana Sven Søren Tatiana Teresa Theodore
Thomas Tiago Timothy Tobias Tomasz Ursula Valentina Vera Victor Victoria Vincent Walter Wei William Xavier Yelena Yuki Yusuf Zachary Zoë Ben Bill Bob Dave Dan Dot Ed Jack Jim Jo Joe Kate Kathy Liz
Gabe Len Lexi Nell Uschi Steffen Tobi Zach Josh Jen Jenny Judy Abby Andy Beth Bella Bobby Charlie Debbie Dick Dolly Eddie Hal Johnny Kit Liam Mick Nate Paddy Rick Sasha Tori Vicky Wendy Niko Lucha Matze Giuli
Matt Max May Mike Ned Nick Pat Pete Ron Sam Steve Sue Ted Tess Tim Tom Tony Will""".split()
KNOWN = {*GIVEN, *MORE}
#: Spellings of given names that are ordinary words when they are not capitalised.
ORDINARY_TOO = {"will", "may", "mark", "dot", "max", "pat", "sue", "grace", "rich", "jan", "an", "li", "ed", "art", "bill", "frank", "felix", "clara"}
LOWER = frozenset(n.lower() for n in KNOWN)
WORDS = re.compile(r"[^\W\d_]+")


def places(text: str) -> list[tuple[int, int]]:
    """Where known given names stand in a text, in any case; those that are ordinary words too only with a capital."""
    return [m.span() for m in WORDS.finditer(text) if (w := m.group().lower()) in LOWER and not (w in ORDINARY_TOO and m.group()[0].islower())]

"""Book categories: an exact name first, else the first keyword in it, else Other."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and the names that belong to them.
NAMES = {
    "Fiction": ["Fiction in English", "Translations into English", "Classic Literature", "British and irish fiction (fictional works by one author)"],
    "Nonfiction": ["Nonfiction"],
    "Mystery/Thriller": ["Detective and mystery stories", "Mystery", "Women detectives", "Private investigators", "Murder", "Police", "American Detective and mystery stories"],
    "Fantasy": ["Fantasy fiction", "American Fantasy fiction", "Magic"],
    "Science Fiction": ["American Science fiction", "Science fiction"],
    "Children's/YA": ["Juvenile fiction", "Children's fiction", "Children's stories", "Juvenile literature"],
    "Romance": ["Romance fiction", "Love stories", "Man-woman relationships"],
    "Horror": ["Horror tales", "Vampires", "Occult fiction"],
    "Biography/Memoir": ["Biographies", "Biography", "Autobiography", "Autobiographies", "Correspondence", "Authors", "American Authors"],
    "History": ["History and criticism", "World War", "Civilization"],
    "Travel": ["Guidebooks", "Description and travel"],
    "Poetry": ["Poetry (poetic works by one author)", "American Poetry"],
    "Short Stories": ["American Short stories", "Short stories", "Literary collections"],
    "Comics/Graphic Novels": ["Comic books", "Comics & graphic novels"],
    "Humor": ["Humorous stories", "American wit and humor", "Anecdotes"],
    "Religion/Spirituality": ["Bible", "Christianity", "Christian life", "Spiritual life", "Buddhism", "Meditations"],
    "Self-Help/Psychology": ["Conduct of life", "Psychology", "Interpersonal relations"],
    "Social/Political": ["Social life and customs", "Politics and government", "Social conditions", "Race relations", "African Americans", "Women"],
    "Science/Nature": ["Animals", "Dinosaurs", "Science"],
    "Cooking": ["Cookery"],
    "Drama": ["Drama"],
    "Philosophy": ["Philosophy", "Literature", "Criticism and interpretation"],
    "Reference/Misc": ["Miscellanea", "Dictionaries", "Handbooks", "Quotations", "Popular works", "Case studies"],
    "Fairy Tales/Folklore": ["Fairy tales", "Folklore", "Legends"],
}
# Keywords in order of precedence.
KEYWORDS = [
    ("Science Fiction", "science fiction"),
    ("Mystery/Thriller", "detective|mystery|thriller|crime"),
    ("Fantasy", "fantasy"),
    ("Horror", "horror|vampire|ghost"),
    ("Romance", "romance|love stor"),
    ("Children's/YA", "juvenile|children|young adult"),
    ("Biography/Memoir", "biography|autobio|memoir"),
    ("History", "history|historical"),
    ("Travel", "travel|guidebook"),
    ("Cooking", "cook|recipe"),
    ("Poetry", "poetry|poem"),
    ("Comics/Graphic Novels", "comic|graphic novel|manga"),
    ("Humor", "humor|humour"),
    ("Religion/Spirituality", "bible|christian|religion|spiritual|buddhis|islam"),
    ("Self-Help/Psychology", "psycholog|self-help|self help|conduct"),
    ("Social/Political", "politic|social"),
    ("Fiction", "fiction"),
    ("Short Stories", "short stor"),
    ("Philosophy", "philosoph"),
    ("Science/Nature", "science|nature|animal"),
    ("Drama", "drama|play"),
    ("Fairy Tales/Folklore", "fairy|folk|legend|myth"),
]


def category(c: Column) -> Column:
    """The category of a raw name; null stays null."""
    raw = F.trim(c)
    exact = F.create_map(*[F.lit(x) for x in chain.from_iterable((n, cat) for cat, names in NAMES.items() for n in names)])
    by_word = F.lit("Other")
    for cat, pattern in reversed(KEYWORDS):
        by_word = F.when(F.lower(raw).rlike(pattern), cat).otherwise(by_word)
    return F.when(raw.isNotNull(), F.coalesce(F.try_element_at(exact, raw), by_word))

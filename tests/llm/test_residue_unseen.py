"""Residue in wordings and languages that no list of the module holds: found by repetition alone."""

import random

from pagelattice.llm import residue

SCHEMA = "id long, title string, summary string, text_excerpt string, error string, domain string"
DRAFTS = ["Tutaj wpisz opis swojej firmy", "Burayı kendi metninizle değiştirin", "Skriv din rubrik här", "ここに本文を入力します テキスト"]
ERRORS = ["Sayfa /{w} {h} üzerinde bulunamadı. Kayıt {n}.", "Strona /{w} nie istnieje na {h}. Zgłoszenie {n}.", "Siden /{w} findes ikke på {h}. Sag {n}."]
TITLES = ["Sayfa bulunamadı", "Nie ma takiej strony"]
BANNERS = ["Ta strona używa ciasteczek.", "Bu site çerez kullanır."]


def corpus(seed=3, pages=1500, sites=60):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("bel", "dor", "fen", "gar", "lan", "mir") for b in ("a", "e", "i", "o") for c in ("na", "ro", "ti", "lum", "ves")]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, true = [], set()
    for i in range(pages):
        site = f"s{r.randrange(sites)}.test"
        title, body = some(4), ". ".join(some(9) for _ in range(3)) + "."
        kind = r.random()
        if kind < 0.10:
            body = r.choice(DRAFTS) + "."
            true.add((i, "text_excerpt"))
        elif kind < 0.22:
            body = r.choice(ERRORS).format(w=r.choice(words), h=site, n=r.randrange(99999))
            true.add((i, "text_excerpt"))
            if r.random() < 0.5:
                title = r.choice(TITLES)
                true.add((i, "title"))
        elif kind < 0.40:
            body = r.choice(BANNERS) + " " + body
        elif kind < 0.45:
            title = "Hata sayfaları üzerine notlar"  # writes about such things
        rows.append((i, title, None, body, None, site))
    # copies of an article on several pages of few sites
    for k in range(6):
        text, title = ". ".join(some(8) for _ in range(3)) + ".", some(4)
        rows += [(pages + 20 * k + j, title, None, text, None, f"s{k * 3 + j % 3}.test") for j in range(12)]
    return rows, true


def test_unseen_wordings(spark):
    rows, true = corpus()
    got = {(r.tab_id, r.field) for r in residue.residue_fields(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    recall, precision = len(got & true) / len(true), len(got & true) / len(got)
    print("unseen wordings: recall", recall, "precision", precision, "cases", len(true))
    assert recall >= 0.97 and precision >= 0.97

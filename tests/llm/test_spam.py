from finloom.llm.spam import STUFFED, page_words, stuffed_pages

PROSE = "The group lowered the tax rate by 12.3%, while the effect will follow next year. Since March, the company reported a gain in the northern region because the port reopened. "
PHRASES = ["low fee fund", "instant loan", "crypto wallet", "robo advisor", "forex signals", "margin account"]
SPAM = {
    "anchors": " ".join(f'<a href="//x.example/{i}">{p}</a>' for i, p in enumerate(PHRASES * 6)),
    "markdown": "\n".join(f"[{p}](www.x.example/{i})" for i, p in enumerate(PHRASES * 6)),
    "urls": "\n".join(f"{p} http://x.example/a?id={i}" for i, p in enumerate(PHRASES * 6)),
    "arrows": "\n".join(" > ".join(PHRASES[i % 4 : i % 4 + 3]) for i in range(14)),
    "commas": ", ".join(PHRASES * 8),
    "dashes": " - ".join(PHRASES * 8),
    "tags": " ".join("#" + p.title().replace(" ", "") for p in PHRASES * 8),
    "offers": " • ".join(f"{p} {10 + i}% off / sku {i * 7} / sale" for i, p in enumerate(PHRASES * 5)),
    "run": " ".join(PHRASES * 8),
    "claims": " ".join(f"Quvexa Holdings {a} cheap {b}." for a in PHRASES for b in PHRASES),
    "spanish": "\n".join("préstamo rápido > fondo sin comisiones > bolsa en vivo" for _ in range(12)),
}
HONEST = {
    "prose": PROSE * 6,
    "table": PROSE + "\n" + "\n".join(f"blended backlog {w} | {i * 17} | {i * 3} | {i}.5%" for i, w in enumerate("abcdefghijklmnop")),
    "contents": PROSE + "\n" + "\n".join(f"Item {i}. Business ............ {i * 9}" for i in range(20)),
    "exhibits": PROSE + "\n" + "\n".join(f"Exhibit 7.{i}  deferred cost agreement dated October {i + 1}, 2024" for i in range(20)),
    "glossary": "\n".join(f"{p}: The segment raised the rate for the northern unit because growers asked for credit." for p in PHRASES),
    "dialogue": "\n".join("Q: Is there any change in the plan?\nA: We see that the plan is on track." for _ in range(8)),
    "few tags": PROSE * 3 + "\nTags: tax rate, shelf space, loan growth\nRelated: https://a.example/1 https://b.example/2",
    "japanese": "物流費の上昇にもかかわらず、経営陣は海外で調整後売上高を36%見直した。" * 8,
    "half": PROSE * 4 + "\n" + ", ".join(PHRASES * 3),
    "cells": "\n".join("| the group said that it | will follow in the next |" for _ in range(6)),
}


def _share(text):
    into, _ = page_words(text)
    return sum(into.get(k, 0) for k in STUFFED) / max(1, sum(into.values()))


def test_shares():
    assert {k: v for k, v in ((k, _share(t)) for k, t in SPAM.items()) if v <= 0.5} == {}
    assert {k: v for k, v in ((k, _share(PROSE + "\n" + t)) for k, t in SPAM.items()) if v <= 0.5} == {}
    assert {k: v for k, v in ((k, _share(t)) for k, t in HONEST.items()) if v > 0.5} == {}


def test_stuffed_pages(spark):
    rows, want = [], set()
    for i, t in enumerate(SPAM.values()):
        for h in range(3):
            rows.append((10 * i + h, f"host{h}", t))
            want.add(10 * i + h)
    rows += [(1000 + i, "host1", t) for i, t in enumerate(HONEST.values())]
    rows += [(2000, None, SPAM["commas"]), (2001, "h", None), (2002, "h", ""), (2003, "h", "   "), (2004, "h", "x" * 100_000), (2005, "h", PROSE * 500)]
    # A list of phrases that no other host has, each once, is no evidence.
    rows += [(2006, "h", ", ".join(f"unheard{i} thing{i}" for i in range(60)))]
    t = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, text string, words string")
    assert {r.doc_id for r in stuffed_pages(t).collect()} == want | {2000}
    assert stuffed_pages(t.limit(0)).count() == 0

JA = ["格安ローン", "投資信託", "暗号資産ウォレット", "株価予想", "即日融資", "配当株ランキング", "外国為替シグナル"]
JA_SPAM = {
    "commas": "、".join(JA * 6),
    "spaces": " ".join(JA * 6),
    "bars": "\n".join("｜".join(JA[i % 4 : i % 4 + 4]) for i in range(12)),
    "tags": " ".join("#" + p for p in JA * 6),
    "anchors": " ".join(f'<a href="//x.example/{i}">{p}</a>' for i, p in enumerate(JA * 6)),
    "after prose": "物流費の上昇にもかかわらず、経営陣は海外で調整後売上高を36%見直した。\n" + "・".join(JA * 6),
    "together": "".join(JA * 8),
}
FOREIGN = {
    "polish": "Spółka odnotowała wzrost przychodów o dwanaście procent dzięki wyższym cenom energii. Zarząd spodziewa się dalszej poprawy marży operacyjnej jeszcze przed końcem roku. Koszty transportu spadły wskutek renegocjacji umów przewozowych. Klienci przemysłowi zwiększyli zamówienia mimo słabszej koniunktury. ",
    "italian": "Il gruppo ha registrato ricavi superiori alle attese grazie ai prezzi più alti. Gli amministratori prevedono margini stabili nel secondo semestre dell'anno prossimo. Le spese logistiche sono diminuite dopo nuovi accordi con i vettori. ",
    "japanese": "株価は上昇、利益は増加、配当は据え置きとなった。受注残高は前年同期を上回り、設備投資は計画通りに進んだ。" * 6,
    "greek": "Η εταιρεία ανακοίνωσε αύξηση εσόδων χάρη στις υψηλότερες τιμές ενέργειας. Η διοίκηση αναμένει σταθερά περιθώρια κέρδους μέχρι το τέλος της χρονιάς. ",
}


def test_any_script_and_language(spark):
    rows = [(10 * i + h, f"host{h}", t) for i, t in enumerate(JA_SPAM.values()) for h in range(6)]
    want = {r[0] for r in rows}
    rows += [(1000 + 10 * i + h, f"host{h}", t * k) for i, t in enumerate(FOREIGN.values()) for h, k in enumerate((1, 1, 1, 1))]
    # What only one host has is no evidence, however often its page repeats it.
    rows += [(5000, "host1", ", ".join(["unheard thing", "other matter", "third subject"] * 20))]
    t = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id for r in stuffed_pages(t).collect()}
    assert got == want

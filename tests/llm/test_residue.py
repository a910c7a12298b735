import pytest

from shardloom.llm.residue import Leaf, branch, messages, open_slots, residue, verdict

CONTENT = "The merge step keeps a copy of the newest segment. Our gateway waits for the batch left by Zolamer."
CASES = [
    ("Dear {{ first_name }}, your shard was moved last night.", "slot"),
    ("Release [VERSION] of kb-main is out. " + CONTENT, "slot"),
    ("This page describes <%= contact %> and more. " + CONTENT, "slot"),
    ("Ihre Anfrage (hier projekt eintragen) wurde angenommen.", "slot"),
    ("Notes on Orzan\n\n404 Not Found\nThe page you asked for does not exist or has moved.\nBack to top", "error"),
    ("502 Bad Gateway You do not have permission to view /Holodue/6. Reload the page or sign in again.", "error"),
    ("Interner Serverfehler\nDer Server konnte die Anfrage nicht bearbeiten.", "error"),
    ("Skip to main content\nPlease enable JavaScript to view this page.\n© Orzan Systems", "script"),
    ("Esta aplicación necesita scripts.\n\nCargando…", "script"),
    ("Lorem ipsum dolor sit amet consectetur. Sed eiusmod tempor incididunt labore.", "filler"),
    ("Dummy paragraph number 53. Text will follow.\n\n... ... ... ... ... ...", "filler"),
    ("blah blah blah blah blah blah blah", "filler"),
    (CONTENT, None),
    ("The linter now rejects pages that still contain {{nombre}} or similar markers. " + CONTENT, None),
    ("Write `$OWNER$` where the name belongs, and the sender replaces it.", None),
    ('In the mail template of Orzan, the marker "<AMOUNT>" stands for the recipient.', None),
    ("```\nprint(f'{name}')\n```\n" + CONTENT, None),
    ('The crawler stores "Please enable JavaScript" pages as empty and counts them.', None),
    ("For 7 minutes the proxy of Orzan answered \"404 Not Found\" although the page existed. " + CONTENT, None),
    ("Turn JavaScript on in the admin console before step 3, because the graphs are drawn in the browser.", None),
    ("Page not found\n\n" + CONTENT, None),
    ("Skip to main content\nField guide to Orzan\nBack to top", None),
    ("", None), (" \n", None), (None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, hash int, verdict string")
    got = {r.doc_id: r.reason for r in residue(df.repartition(3)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_empty_repeated_and_long(spark):
    schema = "doc_id long, text string"
    assert residue(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "lorem ipsum dolor " * 30_000), (2, (CONTENT + "\n") * 5_000), (3, "Access denied"), (3, "Access denied")]
    assert sorted((r.doc_id, r.reason) for r in residue(spark.createDataFrame(rows, schema)).collect()) == [(1, "filler"), (3, "error"), (3, "error")]


def test_leaf_joins_variants():
    leaf = Leaf(agree=0.6)
    a = leaf.add("session <*> expired at noon today")
    assert leaf.add("session <*> expired at dawn today") == a
    assert leaf.add("session <*> expired at dusk today") == a
    assert leaf.templates[a] == "session <*> expired at <> today".split()
    assert leaf.add("user <*> logged out at once") != a
    for i in range(40):  # many templates: the matrix gives the same answers
        leaf.add(" ".join(f"w{i}x{j}" for j in range(6)))
    assert leaf.add("session <*> expired at dusk today") == a and len(leaf.templates) == 42
    assert leaf.add("w7x0 w7x1 w7x2 w7x3 other other") == 9


def test_leaves_by_length_and_first_words():
    split = [m.split(" ") for m in ("a b c d e f g h", "a b c d x x x x", "a b c x e f g h", "a b c d e f g", "a b", "a c")]
    keys = [branch(w, 4) for w in split]
    assert keys[0] == keys[1] and len({keys[0], keys[2], keys[3]}) == 3 and keys[4] == keys[5]


def test_hot_leaves_are_split_with_the_same_result(spark):
    rows = [(i, f"2024-01-0{i % 9 + 1} worker of the proxy {chr(97 + i % 26)}x closed the {chr(97 + i % 17)}y lease") for i in range(300)] + [(1000 + i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [sorted(map(tuple, residue(df, leaf_messages=n).collect())) for n in (3, 50, 5_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == sum(1 for _, want in CASES if want)


def _name(i):
    return "Z" + "".join(chr(97 + i // 26**k % 26) for k in range(3))


@pytest.mark.parametrize("others", [100, 700])
def test_verdicts_do_not_depend_on_the_number_of_messages_in_a_leaf(spark, others):
    # the lists of names are one template, which recurs, in a leaf of 100 messages as in one of 700
    rows = [(0, "404 Not Found\nHarbour list for Ana\nHarbour list for Ben\nHarbour list for Chen")] + [(1 + i, f"Harbour list for {_name(i)}\n{CONTENT}") for i in range(others)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [sorted(map(tuple, residue(df, leaf_messages=n).collect())) for n in (3, 500)] == [[(0, "error")]] * 2


def test_repeated_messages_of_other_workers_are_no_further_messages_of_a_leaf(spark):
    rows = [(0, "404 Not Found\nHarbour list for Ana\nHarbour list for Ben\nHarbour list for Chen")] + [(1 + i, f"Harbour list for {_name(i)}\n{CONTENT}") for i in range(100)]
    df = spark.createDataFrame([(i + 1000 * c, t) for c in range(6) for i, t in rows], "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, residue(df).collect())) == [(1000 * c, "error") for c in range(6)]


def test_merged_words_of_content_are_no_names():
    # neither line is a notice, nor is what they have in common; names merge to a name
    leaf = Leaf()
    for m in ("for hit in search(kolibri_vec, k=<*>):", "for hit in search(amsel_vec, k=<*>):", "for hit in search(meise_vec, k=<*>):"):
        assert verdict(m.split(" ")) == "content" and leaf.add(m) == 0
    assert [verdict(t) for t in leaf.judged()] == ["content"]
    names = Leaf()
    for m in ("The server Orzan failed again.", "The server Tarupha failed again."):
        assert verdict(m.split(" ")) == "error" and names.add(m) == 0
    assert [verdict(t) for t in names.judged()] == ["error"]


@pytest.mark.parametrize("agree", [0.5, 0.7, 1.0])
@pytest.mark.parametrize("n", [2, 4, 9, 16])
def test_indexed_leaves_have_the_same_templates(agree, n):
    def word(i, p):
        return f"w{(i * 2654435761 >> 7 + p) % 5}" if p >= n // 2 else f"p{p}"

    found = [" ".join(word(i, p) for p in range(n)) for i in range(600)]
    plain, indexed = Leaf(agree, indexed=1_000), Leaf(agree, indexed=20)
    plain.MANY = 1_000
    assert [plain.add(m) for m in found] == [indexed.add(m) for m in found]
    assert plain.templates == indexed.templates and list(plain.judged()) == list(indexed.judged())


def test_what_the_words_do_not_know_is_learned_beside_different_notices(spark):
    strange = "Die Kolibris brauchen kurz Ruhe."
    notices = ["404 Not Found", "Access denied", "Service unavailable", "Your session has expired"]
    rows = [(i, f"{n}\n{strange}") for i, n in enumerate(notices)]
    schema = "doc_id long, text string"
    assert {r.doc_id for r in residue(spark.createDataFrame(rows, schema)).collect()} == {0, 1, 2, 3}
    # beside one notice alone, as in copies of one text, or in texts of content too, nothing is learned
    assert residue(spark.createDataFrame([(i, f"404 Not Found\n{strange}") for i in range(9)], schema)).count() == 0
    content = [(10 + i, f"{strange} {CONTENT}") for i in range(9)]
    assert residue(spark.createDataFrame(rows + content, schema)).count() == 0


# texts written for this test, in other words than those of the tables
RESIDUE = [
    "You need to enable JavaScript to run this app.", "Please turn JavaScript on in order to see this page", "Please enable JavaScript to continue using this application.", "This website requires JavaScript. Please activate it and reload the page.",
    "JavaScript has been disabled in your browser", "Your browser does not support JavaScript!", "Bitte schalten Sie JavaScript ein, um die Seite zu nutzen.", "Für diese Website wird JavaScript benötigt.", "Votre navigateur ne supporte pas JavaScript.", "Ce site nécessite JavaScript pour fonctionner correctement.",
    "Debe habilitar JavaScript para usar este sitio.", "Su navegador tiene JavaScript desactivado.", "404", "Error 404: File not found", "403 Forbidden", "500 Internal Server Error\nPlease try again later.", "504 Gateway Timeout", "410 Gone",
    "Sorry, the page you are looking for could not be found.", "We're sorry, something went wrong on our end. Please try again later.", "The requested URL was not found on this server.", "This page is no longer available.", "The site is temporarily down for maintenance. Please check back later.",
    "Die Seite wurde nicht gefunden.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Der Dienst ist vorübergehend nicht verfügbar.", "Désolé, cette page n'existe pas.", "Une erreur est survenue. Veuillez réessayer plus tard.", "Lo sentimos, la página no existe.", "Se ha producido un error. Inténtelo de nuevo más tarde.",
    "Pagina niet gevonden", "Connection refused. The server is not responding.", "Your request could not be processed. Reference: 81-AF-20", "Session timed out. Please log in again.",
    "Proin sagittis nisl rhoncus mattis. Vivamus arcu felis bibendum ut tristique et egestas.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "asdf asdf asdf asdf qwerty qwerty asdf", "Page under construction", "Coming soon!", "Your content goes here", "Insert text here", "This is a placeholder text.", "Hier folgt bald ein Text.", "Contenu à venir", "Contenido próximamente",
    "Dear [FIRST NAME], your order has shipped.", "Dear [First Name], your order has shipped.", "Dear {{user-name}}, your order has shipped.", "Dear __name__, your order has shipped.", "Sehr geehrte Frau ${nachname}, Ihr Paket ist da.", "Hello %FIRSTNAME%, the window is open.", "Total: [insert amount]", "Signed, <insert your name here>",
]
GENUINE = [
    "The migration finished at noon and the queue was empty an hour later.", "JavaScript was designed in ten days and became the language of the web.", "Our crawler now skips pages that ask readers to enable JavaScript, which halved the noise in the index.", "A 404 status tells the client that the origin has no representation for the target, and caches may keep that answer.",
    "How to fix a 502: look at the upstream first, then raise the idle limit of the balancer, and only then restart.", "Lorem ipsum is derived from a work of Cicero written in 45 BC, of which printers garbled a passage.", "Der Lock wird nach fünfzehn Sekunden ohne Herzschlag freigegeben, und der nächste Bewerber erhält ihn.", "La copie de secours prend le relais dès que le nœud principal quitte la grappe.", "El equipo midió la latencia durante la noche y publicó los resultados el lunes.",
    "Placeholders such as \"{{name}}\" are filled by the mailer before the message leaves.", "def __init__(self): pass", "The array a[i] holds one row for every key b[j] of the group.", "Call open(path, mode) and close it again.", "See [Smith 2010] and [Update] below for the proof of this bound.", "The <b>bold</b> and <I>italic</I> tags were kept by the parser.", "Use `{{ user }}` in the header of the mail.",
    "Meeting notes: Ana presented the roadmap, Ben asked about budget, and Chen will draft the plan.", "Page not found\n\nThe article on hummingbirds that used to live here moved to the birds section, where it was merged with the older one on swifts.", "The tests were red since the clock of the runner was ahead by two minutes.", "Reindexing kb-main took 14 minutes and produced 88,120 child chunks.", "__Important__: back up the ledger first.", "Prices rose by 3 % in May, while volumes fell (your mileage in the north may well differ from that of the other regions).",
    "Error handling in the gateway is based on retries with jitter, a budget per tenant, and hedged reads for cold shards.", "The server room was flooded in 1998; since then every rack stands on a plinth of forty centimetres.", "Der Platzhalter {{x}} wird beim Versand ersetzt.", "Tests of the tempo regulator showed that damping halves the ripple.", "Menu of the week: lentil soup on Monday, baked trout on Tuesday, dumplings on Wednesday.", "Skip to main content\nThe harbour was dredged twice and the pier extended.\nBack to top",
]


# a second set, written when the first had been looked at
RESIDUE += ["Sorry, you need JavaScript turned on to use this website.","This site works best with JavaScript. Please enable it in your browser's preferences.","Aktivieren Sie bitte JavaScript in den Einstellungen Ihres Browsers.","JavaScript est désactivé. Veuillez l'activer pour continuer.","Este sitio requiere JavaScript.","HTTP Error 503. The service is unavailable.","Oops, that page can't be found.","Uh oh. We couldn't find what you were looking for.","429 Too Many Requests","Access to this resource has been denied.","Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.","Zugriff auf diese Seite verweigert","La page que vous cherchez est introuvable.","Erreur 500 : erreur interne du serveur","Página no encontrada. Volver al inicio","El servidor no responde. Inténtelo más tarde.","We are currently performing maintenance. Please come back later.","Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.","Praesent sapien massa, convallis a pellentesque nec, egestas non nisi.","test test test test test","Your text goes here. Add a description of your page.","Page content to be added soon","Platzhaltertext für diesen Abschnitt","Texte provisoire","Hi {first_name}, thanks for joining us!","Dear <<Customer Name>>, your invoice is attached.","Bonjour [Prénom Nom], votre commande est prête.","Order #{{ order.id }} will arrive on {{ order.date }}."]
GENUINE += ["When the page was not found, the team restored it from Tuesday's backup and added a redirect.","The café on the corner serves the best lemon tart in the district.","Enable the cache with the flag --cache and watch the hit rate climb over an hour.","Der Fehler trat nur auf, wenn zwei Knoten gleichzeitig starteten; seit Version 4 ist er behoben.","Nous avons mesuré la latence de trois serveurs pendant une semaine.","La base de datos guarda cada cambio con su número de secuencia.","Internal server errors fell from 312 to 4 a day after the pool was enlarged.","A placeholder such as {name} is replaced when the mail goes out.","See section [A1] and the table (add 5 % for storage) for costs.","The test of the new lock took place on Friday and lasted two hours.","Contact lenses were invented in 1888 by a German ophthalmologist.","Loading docks are open from six to nine."]


def test_texts_in_other_words(spark):
    rows = [(i, t.replace("\\n", "\n")) for i, t in enumerate(RESIDUE + GENUINE)]
    found = {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = len([i for i in found if i < len(RESIDUE)])
    missed = [t for i, t in enumerate(RESIDUE) if i not in found]
    wrong = [t for i, t in rows if i in found and i >= len(RESIDUE)]
    assert right >= 0.95 * len(RESIDUE) and right >= 0.95 * len(found), (missed, wrong)


@pytest.mark.parametrize("text", ["a {1} b", "XXTEAMXX", "Hola ~USER_EMAIL~:", "<<your enlace here>>", "*|NOMBRE|*", "%(link)s", "{% include \"date\" %}", "<À COMPLÉTER : DATUM>", "Owner: «first_name»"])
def test_slots(text):
    assert open_slots(text)


@pytest.mark.parametrize("text", ["[INFO] started", "x = a[i]", "see <b>this</b>", "« 404 »", "__init__ runs", "call(a, b) (line 5)", "100 % of 5 %"])
def test_no_slots(text):
    assert not open_slots(text)


SLOTS_BESIDE = [
    "```\nrun()\nDear {{ first_name }}, your shard was moved.", "```\na\n```\nDear ${name},\n```\nb", "Dear <NAME>, see <b>this</b>.", "Meet <TEAM> on <DATE></p>",
    "Thank you for using our template, {{ first_name }}.", "Die Marke {{ brand }} ist neu.", "Ihre Vorlage für [KUNDE] ist fertig.", "La marca de su coche: ${car}", "The template was sent to %(name)s.",
]
NONE_BESIDE = ["See <B>this</B> and <TD>that</TD>.", "```\n{{ x }}\n```\ntext", "Pages with {{nombre}} or similar markers are rejected.", "The placeholder {{x}} is replaced.", "Die Marke `{{x}}` ist neu.", "In the mail template, the marker &quot;{{ x }}&quot; stands for the recipient."]


@pytest.mark.parametrize("text,found", [(t, True) for t in SLOTS_BESIDE] + [(t, False) for t in NONE_BESIDE])
def test_slots_beside_fences_tags_and_words(text, found):
    assert open_slots(text) == found


def test_classes():
    kind = lambda m: verdict(messages(m)[0].split(" "))
    assert kind("Back to top") == "chrome" and kind("Access denied") == "error" and kind("the merge step outgrew the lease") == "content"
    assert kind("Checking your browser before accessing the site.") in ("aid", "error") and kind("Proin sagittis nisl rhoncus urna.") == "filler"

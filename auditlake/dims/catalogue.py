"""Texts shown for each problem: title, description, remediation, code, owner, effort, confidence."""

# Owner, effort and confidence are fixed values; the wording is ours.
CHECKS = {
    "heading-no-h1": ("Nessun titolo di primo livello", "Senza h1 non si capisce di che cosa parla la pagina.", "Marcare il titolo principale come h1.", "<h1>Orari della biblioteca</h1>", "frontend", "basso", 0.95),
    "heading-multiple-h1": ("Più titoli di primo livello", "Diversi h1 confondono l'argomento della pagina.", "Lasciare un solo h1 e abbassare gli altri.", None, "frontend", "basso", 0.9),
    "heading-skipped-level": ("Livello di titolo saltato", "Un livello mancante fa pensare a una sezione persa.", "Usare i livelli in ordine; l'aspetto si regola nel CSS.", None, "frontend", "basso", 0.85),
    "heading-empty": ("Intestazione senza testo", "Un'intestazione vuota viene annunciata a vuoto.", "Toglierla o riempirla.", None, "frontend", "basso", 0.95),
    "landmark-no-main": ("Area principale assente", "Non si può saltare subito al contenuto.", "Racchiudere il contenuto in un elemento main.", "<main id=\"corpo\">…</main>", "frontend", "basso", 0.95),
    "landmark-multiple-main": ("Più aree principali", "Due aree principali si contendono il contenuto.", "Tenerne una.", None, "frontend", "basso", 0.9),
    "landmark-nav-unlabeled": ("Menu non distinguibili", "Più aree di navigazione hanno lo stesso nome generico.", "Dare a ciascuna un'etichetta.", "<nav aria-label=\"Menu di servizio\">…</nav>", "frontend", "basso", 0.85),
    "title-missing": ("Titolo della pagina assente", "La scheda del browser e lo screen reader non hanno un nome da dire.", "Compilare l'elemento title.", None, "cms", "basso", 0.95),
    "title-too-short": ("Titolo della pagina troppo breve", "Poche lettere non bastano a riconoscere la pagina.", "Scrivere argomento e nome del sito.", None, "cms", "basso", 0.6),
    "skiplink-missing": ("Salto al contenuto assente", "Da tastiera si ripercorre il menu a ogni pagina.", "Mettere in testa un collegamento al contenuto.", "<a href=\"#corpo\">Salta al contenuto</a>", "frontend", "basso", 0.75),
    "img-empty-alt-in-link": ("Collegamento con figura muta", "La figura è l'unico contenuto e non dice nulla.", "Scrivere nell'alt dove si arriva.", "<a href=\"/\"><img src=\"marchio.svg\" alt=\"Inizio\"></a>", "frontend", "basso", 0.95),
    "img-empty-alt-review": ("Figura decorativa da confermare", "L'alt vuoto vale solo se la figura non dice nulla.", "Controllare e, se serve, descriverla.", None, "contenuti", "medio", 0.3),
    "img-alt-is-filename": ("Alt preso dal nome del file", "Il nome del file non spiega la figura.", "Sostituirlo con una descrizione.", None, "contenuti", "medio", 0.85),
    "img-alt-placeholder": ("Alt riempitivo", "Una parola generica non descrive la figura.", "Dire che cosa mostra.", None, "contenuti", "medio", 0.85),
    "img-alt-too-long": ("Alt troppo esteso", "Un alt lungo si ascolta tutto d'un fiato.", "Accorciarlo e spostare il resto nel testo.", None, "contenuti", "medio", 0.6),
    "img-alt-duplicates-caption": ("Alt uguale alla didascalia", "La stessa frase viene letta due volte.", "Differenziare alt e didascalia.", None, "contenuti", "basso", 0.7),
    "bg-image-review": ("Sfondo figurato da controllare", "Uno sfondo con informazione non arriva a tutti.", "Riportare l'informazione in testo.", None, "design", "medio", 0.25),
    "link-generic-text": ("Collegamento dal testo vago", "Fuori contesto non si sa dove porta.", "Nominare la destinazione.", "<a href=\"/orari\">Orari della biblioteca</a>", "contenuti", "medio", 0.8),
    "link-same-text-different-targets": ("Stesso testo, mete diverse", "Collegamenti omonimi portano altrove.", "Rendere unici i testi.", None, "contenuti", "medio", 0.7),
    "link-new-window-unannounced": ("Nuova finestra non annunciata", "Il contesto cambia senza avviso.", "Avvisare o restare nella stessa finestra.", None, "contenuti", "basso", 0.75),
    "link-raw-url-text": ("Indirizzo usato come testo", "Un indirizzo intero si ascolta lettera per lettera.", "Scrivere un testo leggibile.", None, "contenuti", "basso", 0.8),
    "form-placeholder-as-label": ("Segnaposto al posto dell'etichetta", "Il segnaposto scompare mentre si scrive.", "Aggiungere un'etichetta stabile.", "<label for=\"cap\">CAP</label><input id=\"cap\">", "frontend", "basso", 0.9),
    "form-required-not-indicated": ("Obbligo non dichiarato", "L'etichetta non dice che il campo serve.", "Scriverlo nell'etichetta.", None, "frontend", "basso", 0.65),
    "form-missing-autocomplete": ("Dato personale senza completamento", "Il browser non può proporre il valore.", "Aggiungere l'attributo autocomplete.", None, "frontend", "basso", 0.8),
    "form-radiogroup-no-fieldset": ("Scelte senza domanda", "Le opzioni non dicono a che domanda rispondono.", "Usare fieldset e legend.", "<fieldset><legend>Consegna</legend>…</fieldset>", "frontend", "basso", 0.85),
    "form-search-no-submit": ("Ricerca senza comando", "Manca un pulsante per cercare.", "Aggiungere un pulsante di invio.", None, "frontend", "basso", 0.7),
    "focus-not-visible": ("Focus che non si vede", "Da tastiera non si sa dove ci si trova.", "Ripristinare un bordo di focus evidente.", ":focus-visible { outline: 3px solid }", "frontend", "basso", 0.9),
    "keyboard-trap-suspected": ("Possibile trappola da tastiera", "Il focus torna sempre sullo stesso punto.", "Permettere di uscire con Tab o Esc.", None, "frontend", "alto", 0.6),
    "keyboard-focus-on-hidden": ("Focus su elemento nascosto", "Il focus sparisce dalla vista.", "Togliere dal giro gli elementi nascosti.", None, "frontend", "medio", 0.8),
    "keyboard-positive-tabindex": ("Ordine di tabulazione forzato", "Un tabindex positivo scavalca il documento.", "Usare 0 e riordinare il markup.", None, "frontend", "medio", 0.9),
    "focus-order-suspicious": ("Ordine di focus da rivedere", "Il focus risale più volte nella pagina.", "Allineare ordine visivo e codice.", None, "frontend", "medio", 0.35),
    "keyboard-no-focusable": ("Niente riceve il focus", "La tastiera non raggiunge alcun elemento.", "Usare controlli nativi.", None, "frontend", "alto", 0.7),
    "consent-not-keyboard-reachable": ("Avviso sui cookie fuori portata", "Da tastiera l'avviso non si chiude.", "Renderne raggiungibili i comandi.", None, "frontend", "medio", 0.85),
    "consent-not-dismissable": ("Avviso sui cookie non chiuso", "L'avviso resta davanti alla pagina.", "Indicare il comando di chiusura.", None, "frontend", "basso", 0.5),
    "contrast-hover-insufficient": ("Contrasto perso al passaggio", "Al passaggio del puntatore il testo sbiadisce.", "Scegliere un colore più netto per lo stato.", None, "design", "basso", 0.85),
    "reflow-horizontal-scroll": ("Scorrimento laterale su schermo stretto", "A 320 pixel la pagina esce dal bordo.", "Evitare larghezze fisse.", None, "frontend", "medio", 0.9),
    "reflow-overflowing-element": ("Elemento oltre il bordo", "A 320 pixel un elemento sporge.", "Rendere l'elemento flessibile.", "img { max-width: 100% }", "frontend", "medio", 0.9),
    "text-spacing-clipped": ("Testo tagliato con più spazio", "Con spaziatura ampia il testo si perde.", "Togliere altezze fisse e tagli.", None, "frontend", "medio", 0.8),
}

RULES = {
    "link-in-text-block": ("Link distinto solo dal colore", "Nel testo il link si nota solo per tinta.", "Sottolinearlo.", None, "design", "basso", 0.75),
    "color-contrast": ("Testo poco contrastato", "Il testo si confonde con lo sfondo.", "Arrivare a 4.5:1, o 3:1 se grande.", None, "design", "basso", 0.8),
    "link-name": ("Link senza nome", "Viene annunciato senza meta.", "Dargli un testo o aria-label.", "<a href=\"/cerca\" aria-label=\"Cerca\">…</a>", "frontend", "basso", 0.95),
    "button-name": ("Pulsante senza nome", "Viene annunciato senza funzione.", "Dargli un testo o aria-label.", "<button aria-label=\"Chiudi\">×</button>", "frontend", "basso", 0.95),
    "image-alt": ("Figura senza alternativa", "Manca l'attributo alt.", "Aggiungerlo, vuoto se decorativa.", "<img src=\"x.jpg\" alt=\"Sala lettura\">", "contenuti", "basso", 0.95),
    "html-has-lang": ("Lingua non dichiarata", "La voce legge con la pronuncia sbagliata.", "Scrivere lang sull'elemento html.", "<html lang=\"it\">", "frontend", "basso", 0.95),
    "html-lang-valid": ("Codice di lingua errato", "Il codice non esiste.", "Usare un codice valido.", None, "frontend", "basso", 0.95),
    "label": ("Campo senza etichetta", "Il campo viene annunciato senza nome.", "Associare un'etichetta.", "<label for=\"q\">Cerca</label>", "frontend", "basso", 0.95),
    "select-name": ("Tendina senza etichetta", "La tendina non ha nome.", "Associare un'etichetta.", None, "frontend", "basso", 0.95),
    "document-title": ("Documento senza titolo", "Manca l'elemento title.", "Compilarlo.", None, "cms", "basso", 0.95),
    "duplicate-id": ("Id ripetuti", "Due elementi portano un solo id.", "Renderli unici.", None, "frontend", "medio", 0.9),
    "duplicate-id-active": ("Id ripetuti su controlli", "Etichette e comandi puntano a un doppione.", "Renderli unici.", None, "frontend", "medio", 0.9),
    "heading-order": ("Titoli fuori ordine", "La gerarchia dei titoli salta.", "Rimettere in fila i livelli.", None, "frontend", "basso", 0.85),
    "landmark-one-main": ("Area main mancante", "Il contenuto non è delimitato.", "Usare main.", None, "frontend", "basso", 0.9),
    "region": ("Contenuto fuori area", "Una parte non sta in alcuna area.", "Portarla in un'area.", None, "frontend", "medio", 0.7),
    "bypass": ("Blocchi non saltabili", "Manca un modo di saltare le parti ripetute.", "Aggiungere un salto.", None, "frontend", "basso", 0.85),
    "list": ("Elenco malformato", "L'elenco contiene figli estranei.", "Lasciare solo voci.", None, "frontend", "basso", 0.9),
    "listitem": ("Voce senza elenco", "La voce è fuori da ul o ol.", "Rimetterla nell'elenco.", None, "frontend", "basso", 0.9),
    "aria-required-attr": ("Attributi ARIA mancanti", "Il ruolo pretende altri attributi.", "Aggiungerli.", None, "frontend", "medio", 0.9),
    "aria-valid-attr-value": ("Valore ARIA errato", "Il valore non è ammesso.", "Correggerlo.", None, "frontend", "medio", 0.9),
    "aria-hidden-focus": ("Nascosto ma focalizzabile", "Il focus arriva dove non si annuncia.", "Togliere il focus o aria-hidden.", None, "frontend", "medio", 0.9),
    "nested-interactive": ("Comandi annidati", "Un comando ne contiene un altro.", "Separarli.", None, "frontend", "medio", 0.9),
    "frame-title": ("Riquadro senza titolo", "Non si sa che cosa è incorporato.", "Dare un title.", "<iframe title=\"Mappa\"></iframe>", "frontend", "basso", 0.95),
    "meta-viewport": ("Ingrandimento bloccato", "La pagina vieta lo zoom.", "Togliere il limite.", None, "frontend", "basso", 0.95),
    "target-size": ("Bersaglio piccolo", "L'area da toccare è stretta.", "Portarla a 24 pixel.", None, "design", "basso", 0.85),
    "scrollable-region-focusable": ("Area scorrevole irraggiungibile", "Da tastiera non si scorre.", "Dare tabindex 0.", None, "frontend", "basso", 0.8),
    "autocomplete-valid": ("Completamento errato", "Il valore di autocomplete non esiste.", "Usare un valore previsto.", None, "frontend", "basso", 0.9),
    "form-field-multiple-labels": ("Campo con due etichette", "Il nome del campo è ambiguo.", "Tenerne una.", None, "frontend", "basso", 0.85),
    "td-headers-attr": ("Rimandi di tabella errati", "Le celle puntano a intestazioni assenti.", "Sistemare headers.", None, "frontend", "medio", 0.9),
    "th-has-data-cells": ("Intestazione senza dati", "L'intestazione non governa celle.", "Rivedere la tabella.", None, "frontend", "medio", 0.8),
    "svg-img-alt": ("Disegno SVG muto", "L'SVG non ha nome.", "Aggiungere title o aria-label.", None, "frontend", "basso", 0.9),
    "role-img-alt": ("Ruolo figura senza nome", "Il ruolo img non ha nome.", "Aggiungere aria-label.", None, "frontend", "basso", 0.9),
    "object-alt": ("Oggetto senza alternativa", "L'oggetto incorporato non ha testo.", "Aggiungerne uno.", None, "frontend", "basso", 0.85),
    "input-image-alt": ("Pulsante figura muto", "Il pulsante immagine non ha alt.", "Descrivere l'azione.", None, "frontend", "basso", 0.95),
    "meta-refresh": ("Pagina che si ricarica", "La pagina cambia da sola.", "Togliere l'aggiornamento.", None, "frontend", "medio", 0.9),
}

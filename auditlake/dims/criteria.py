"""Success criteria of WCAG 2.1 A/AA and the six added by 2.2."""

# Id, official Italian title, level, principle, automation class, baseline,
# then a plain sentence and the people concerned.
_ROWS = [
    ("1.1.1", "Contenuti non testuali", "A", "percepibile", "partial", "Immagini e icone hanno un testo che ne dice lo scopo.", "non vedenti, screen reader, ipovedenti"),
    ("1.2.1", "Solo audio e solo video (preregistrato)", "A", "percepibile", "judgment", "L'audio ha una trascrizione, il video muto un equivalente.", "non vedenti, sordi"),
    ("1.2.2", "Sottotitoli (preregistrato)", "A", "percepibile", "partial", "I video parlati hanno sottotitoli sincronizzati.", "sordi"),
    ("1.2.3", "Audiodescrizione o alternativa testuale (preregistrato)", "A", "percepibile", "judgment", "Quel che si vede nel video esiste anche a voce o in testo.", "non vedenti"),
    ("1.2.4", "Sottotitoli (in diretta)", "AA", "percepibile", "judgment", "Anche le dirette sono sottotitolate.", "sordi"),
    ("1.2.5", "Audiodescrizione (preregistrato)", "AA", "percepibile", "judgment", "I video registrati offrono una traccia descritta.", "non vedenti"),
    ("1.3.1", "Informazioni e correlazioni", "A", "percepibile", "partial", "La struttura visibile esiste anche nel markup.", "non vedenti, screen reader, cognitivi"),
    ("1.3.2", "Sequenza significativa", "A", "percepibile", "partial", "L'ordine del codice si legge con senso.", "non vedenti, screen reader, tastiera"),
    ("1.3.3", "Caratteristiche sensoriali", "A", "percepibile", "judgment", "Le istruzioni non si affidano solo a forma, colore o posizione.", "non vedenti, ipovedenti, daltonici, cognitivi"),
    ("1.3.4", "Orientamento", "AA", "percepibile", "deterministic", "La pagina funziona in verticale e in orizzontale.", "motori, ipovedenti"),
    ("1.3.5", "Identificazione dello scopo dell'input", "AA", "percepibile", "deterministic", "I campi di dati personali dichiarano il loro scopo.", "cognitivi, motori"),
    ("1.4.1", "Uso del colore", "A", "percepibile", "partial", "Il colore non è l'unico segnale.", "daltonici, non vedenti, ipovedenti"),
    ("1.4.2", "Controllo dell'audio", "A", "percepibile", "partial", "Un audio che parte da solo si può fermare.", "screen reader, cognitivi"),
    ("1.4.3", "Contrasto (minimo)", "AA", "percepibile", "deterministic", "Il testo contrasta con lo sfondo almeno 4.5:1, 3:1 se grande.", "ipovedenti, daltonici, anziani"),
    ("1.4.4", "Ridimensionamento del testo", "AA", "percepibile", "partial", "Al 200% il testo si legge ancora.", "ipovedenti"),
    ("1.4.5", "Immagini di testo", "AA", "percepibile", "partial", "Le parole sono testo, non figure.", "ipovedenti, non vedenti, screen reader"),
    ("1.4.10", "Riflusso", "AA", "percepibile", "deterministic", "A 320 pixel non serve scorrere di lato.", "ipovedenti, motori"),
    ("1.4.11", "Contrasto del contenuto non testuale", "AA", "percepibile", "partial", "Bordi e icone utili contrastano almeno 3:1.", "ipovedenti, daltonici"),
    ("1.4.12", "Spaziatura del testo", "AA", "percepibile", "deterministic", "Con più spazio fra righe e lettere nulla si taglia.", "ipovedenti, cognitivi, dislessici"),
    ("1.4.13", "Contenuto in hover o focus", "AA", "percepibile", "partial", "Ciò che compare al passaggio si chiude e non scappa.", "ipovedenti, motori, tastiera"),
    ("2.1.1", "Tastiera", "A", "utilizzabile", "partial", "Ogni funzione si usa anche senza mouse.", "tastiera, motori, non vedenti, screen reader"),
    ("2.1.2", "Nessuna trappola per la tastiera", "A", "utilizzabile", "deterministic", "Da ogni elemento si esce con la tastiera.", "tastiera, motori, non vedenti"),
    ("2.1.4", "Scorciatoie da tastiera con caratteri", "A", "utilizzabile", "partial", "Le scorciatoie a un tasto si possono spegnere.", "motori, comandi vocali"),
    ("2.2.1", "Regolazione dei tempi", "A", "utilizzabile", "judgment", "I limiti di tempo si allungano o si tolgono.", "cognitivi, motori, ipovedenti"),
    ("2.2.2", "Pausa, stop, nascondi", "A", "utilizzabile", "partial", "Quel che si muove da solo si mette in pausa.", "cognitivi, vestibolari, ipovedenti"),
    ("2.3.1", "Tre lampeggiamenti o inferiore alla soglia", "A", "utilizzabile", "judgment", "Niente lampeggia oltre tre volte al secondo.", "epilettici"),
    ("2.4.1", "Salto di blocchi", "A", "utilizzabile", "partial", "Si può andare dritti al contenuto.", "tastiera, non vedenti, screen reader, motori"),
    ("2.4.2", "Pagina titolata", "A", "utilizzabile", "partial", "Il titolo della pagina la descrive.", "non vedenti, screen reader, cognitivi"),
    ("2.4.3", "Ordine del focus", "A", "utilizzabile", "partial", "Il tasto Tab segue un ordine logico.", "tastiera, non vedenti, motori"),
    ("2.4.4", "Scopo del link (nel contesto)", "A", "utilizzabile", "partial", "Si capisce dove porta un link.", "non vedenti, screen reader, cognitivi"),
    ("2.4.5", "Più modi", "AA", "utilizzabile", "partial", "Ogni pagina si raggiunge per più strade.", "cognitivi, non vedenti"),
    ("2.4.6", "Intestazioni ed etichette", "AA", "utilizzabile", "partial", "Titoli ed etichette dicono di che si tratta.", "non vedenti, screen reader, cognitivi"),
    ("2.4.7", "Focus visibile", "AA", "utilizzabile", "deterministic", "Si vede sempre dove è il focus.", "tastiera, ipovedenti, motori"),
    ("2.5.1", "Gesti del puntatore", "A", "utilizzabile", "judgment", "I gesti complessi hanno un'alternativa semplice.", "motori"),
    ("2.5.2", "Annullamento del puntatore", "A", "utilizzabile", "judgment", "L'azione scatta al rilascio e si può annullare.", "motori, cognitivi"),
    ("2.5.3", "Etichetta nel nome", "A", "utilizzabile", "deterministic", "Il nome accessibile contiene il testo visibile.", "comandi vocali, motori, screen reader"),
    ("2.5.4", "Attivazione da movimento", "A", "utilizzabile", "judgment", "Le funzioni a movimento hanno un comando normale.", "motori"),
    ("3.1.1", "Lingua della pagina", "A", "comprensibile", "deterministic", "La pagina dichiara in che lingua è scritta.", "non vedenti, screen reader, cognitivi"),
    ("3.1.2", "Lingua delle parti", "AA", "comprensibile", "partial", "I brani in altra lingua sono marcati.", "non vedenti, screen reader"),
    ("3.2.1", "Al focus", "A", "comprensibile", "partial", "Ricevere il focus non cambia contesto.", "tastiera, cognitivi, non vedenti"),
    ("3.2.2", "All'input", "A", "comprensibile", "partial", "Compilare un campo non provoca sorprese.", "cognitivi, non vedenti, tastiera"),
    ("3.2.3", "Navigazione coerente", "AA", "comprensibile", "partial", "I menu restano nello stesso ordine ovunque.", "cognitivi, non vedenti, ipovedenti"),
    ("3.2.4", "Identificazione coerente", "AA", "comprensibile", "partial", "La stessa funzione ha sempre lo stesso nome.", "cognitivi, non vedenti, screen reader"),
    ("3.3.1", "Identificazione degli errori", "A", "comprensibile", "partial", "Gli errori sono spiegati a parole.", "non vedenti, daltonici, cognitivi"),
    ("3.3.2", "Etichette o istruzioni", "A", "comprensibile", "deterministic", "Ogni campo ha un'etichetta nel codice.", "non vedenti, screen reader, cognitivi"),
    ("3.3.3", "Suggerimento per gli errori", "AA", "comprensibile", "judgment", "Se il rimedio è noto, viene suggerito.", "cognitivi, non vedenti"),
    ("3.3.4", "Prevenzione degli errori (legali, finanziari, dati)", "AA", "comprensibile", "judgment", "Le operazioni importanti si rivedono o annullano.", "cognitivi, motori, non vedenti"),
    ("4.1.1", "Analisi sintattica", "A", "robusto", "deterministic", "Il markup è ben formato e gli id sono unici.", "screen reader, non vedenti"),
    ("4.1.2", "Nome, ruolo, valore", "A", "robusto", "partial", "Ogni controllo dice cos'è, come si chiama e in che stato è.", "non vedenti, screen reader, comandi vocali"),
    ("4.1.3", "Messaggi di stato", "AA", "robusto", "partial", "I messaggi che appaiono vengono annunciati.", "non vedenti, screen reader"),
]
_ADDED = [
    ("2.4.11", "Focus non oscurato (minimo)", "AA", "utilizzabile", "deterministic", "Chi ha il focus non sparisce sotto altri strati.", "tastiera, ipovedenti, motori"),
    ("2.5.7", "Trascinamento", "AA", "utilizzabile", "judgment", "Il trascinamento ha un'alternativa a clic.", "motori"),
    ("2.5.8", "Dimensione del target (minimo)", "AA", "utilizzabile", "deterministic", "I bersagli misurano almeno 24x24 pixel.", "motori, utenti mobili"),
    ("3.2.6", "Aiuto coerente", "A", "comprensibile", "partial", "L'aiuto sta sempre nello stesso posto.", "cognitivi"),
    ("3.3.7", "Inserimento ridondante", "A", "comprensibile", "judgment", "Un dato già dato non si richiede.", "cognitivi, motori"),
    ("3.3.8", "Autenticazione accessibile (minimo)", "AA", "comprensibile", "judgment", "Entrare non richiede prove di memoria.", "cognitivi, non vedenti"),
]


def _expand(rows, baseline):
    return [(i, t, lv, p, a, baseline, plain, users.split(", ")) for i, t, lv, p, a, plain, users in rows]


CRITERIA = _expand(_ROWS, True) + _expand(_ADDED, False)

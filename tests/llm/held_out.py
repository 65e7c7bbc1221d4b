"""Sentences for held-out accuracy: none of them is in the training module."""

POSITIVE = {
    "en": ["Tested-by: {P} <{E}>", "We owe this idea to Mr {P}.", "It was {P} ({E}) who found the leak.", "Reviewer: {P}", "Author: {P}\nVersion {v}", "In a note signed by {P} the limit is raised.", "{P} writes: do not merge yet.", "{P} said no.",
           "On behalf of {P} we close the case.", "The invoice was checked by {P}.", "Ms {P} moved to the {o}.", "Ask for {P} at the desk.", "{P}, tel. {N}, is on duty.", "If in doubt ring {N}.", "Our new number: {N}", "Reach me on {N} or {E}.", "Mail {E} first.",
           "subscribe with {E}", "Bounced: {E}", "The badge shows passport no. {I}.", "The tax identification number, {I}, leaked.", "Scan of ID card {I}", "Social security: {I}", "His personal number {I} was masked.", "The stand is at {A}.", "Please post it to {A}.",
           "Head office: {A}", "The meeting takes place at {A}.", "Maintainer: {P} <{E}>", "-- \n{P}\n{N}\n{E}"],
    "de": ["Ansprechpartnerin ist Frau {P}.", "Geprüft von {P} im Mai.", "Herrn {P}, {A}", "Rufen Sie uns an: {N}", "Antwort bitte an {E}.", "Der Personalausweis {I} lag bei.", "Steuernummer: {I}", "Postanschrift: {A}", "Laut {P} fehlt nichts."],
    "fr": ["Signalé par {P} hier.", "Selon Monsieur {P}, rien ne manque.", "Appelez le {N}.", "Envoyez tout à {E}.", "Numéro de passeport : {I}", "Sécurité sociale : {I}", "Adresse postale : {A}", "Le siège est au {A}."],
    "es": ["Informado por {P} ayer.", "Según el señor {P}, no falta nada.", "Llame al {N}.", "Envíe todo a {E}.", "Número de pasaporte: {I}", "Seguridad social: {I}", "Dirección postal: {A}", "La sede está en {A}."],
}
NEGATIVE = [
    "The {o} has no objections.", "Members of the {o} met twice.", "Shipment {u} is late.", "Receipt {u} was lost.", "Item {u} is sold out.", "version {v}, build {u}", "commit {h}", "The digest {h} is new.", "port {f} is open", "It took {y} minutes and {y2} seconds.",
    "git@vcs.{w}.test:{w}/{k}.git", "pkg:npm/%40{w}/{k}@{v}", "since {d}", "{y2} Lane Markings", "Figure {z} Street Plan", "{W} Browser {v}", "La commande numéro {u} manque.", "Auftrag {u} fehlt.", "El pedido {u} falta.", "All rights reserved by the {o}.",
]

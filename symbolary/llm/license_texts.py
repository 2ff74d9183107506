"""What the licence classifier is trained on: sentences of licences and notices by family, and other sentences.

Sentences of licences are quoted from their published texts; notices are the ways in which they are named.
"""

from __future__ import annotations

#: Words that carry no meaning by themselves in the corpus' languages.
COMMON = frozenset(
    """a about after all also an and any are as at be been before but by can could did do does each for from had has have he her
    his how i if in into is it its may more most must no not of on one only or other our out she should so some such than that
    the their them then there these they this those to under up was we were what when where which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour que qui sa
    se ses son sont sous sur un une vous aber als am an auf aus bei das dem den der des die ein eine einem einen einer es für
    hat im ist kann mit nach nicht noch nur oder sich sie sind so über um und unter von vor war was wenn wer wie wird zu zum
    zur al como con cual de del el ella en era es esta este fue ha la las lo los más muy no o para pero por que se sin sobre
    su sus un una y ya""".split()
)

TEMPLATES = {
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license version 3", "released under the agpl v3", "this project is distributed under the agpl 3 0 license",
    ),
    "all_rights_reserved": (
        "all rights reserved", "copyright by the authors all rights reserved", "copyright 2020 the company all rights reserved worldwide", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
        "no part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher", "this document is proprietary and confidential and may not be copied without permission",
        "der nachdruck auch auszugsweise ist ohne schriftliche genehmigung des verlages nicht gestattet", "toute reproduction même partielle est interdite sans autorisation écrite", "queda prohibida la reproducción total o parcial sin autorización escrita",
    ),
    "apache": (
        "licensed under the apache license version 2 0", "released under the apache license 2 0", "you may not use this file except in compliance with the apache license", "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "this project is distributed under the terms of the apache 2 0 license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "veröffentlicht unter der apache lizenz version 2 0", "distribué sous licence apache version 2 0", "publicado bajo la licencia apache versión 2 0",
    ),
    "bsd": (
        "licensed under the bsd 3 clause license", "released under the bsd license", "distributed under the terms of the bsd 2 clause license", "use of this source code is governed by a bsd style license that can be found in the license file",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "veröffentlicht unter der bsd lizenz", "distribué sous licence bsd", "publicado bajo la licencia bsd",
    ),
    "cc": (
        "licensed under cc by nc 4 0", "licensed under cc by sa 4 0", "licensed under cc by 4 0", "available under a cc by nd license", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0",
        "creative commons attribution sharealike 3 0 unported license", "text is available under the creative commons attribution sharealike license additional terms may apply",
        "dieses werk ist unter einer creative commons lizenz vom typ namensnennung 4 0 international zugänglich", "cette œuvre est mise à disposition selon les termes de la licence creative commons attribution 4 0 international",
        "esta obra está bajo una licencia creative commons atribución 4 0 internacional", "to view a copy of this license visit http creativecommons org licenses by 4 0",
    ),
    "cc0": (
        "this work is dedicated to the public domain", "released into the public domain without any license", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0 1 0 universal", "released under the creative commons zero license cc0",
        "this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software for any purpose", "dieses werk ist gemeinfrei", "cette œuvre appartient au domaine public", "esta obra es de dominio público",
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "licensed under the eclipse public license v1 0", "distributed under the epl 2 0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3", "released under the gnu general public license version 2 or later", "licensed under the gpl version 3", "distributed under the gpl v3", "distributed under the gpl v2 or later", "this project is available under the gnu gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program", "veröffentlicht unter der gnu general public license gpl version 3", "ce programme est distribué sous licence gnu gpl version 3", "este programa se distribuye bajo la licencia gnu gpl versión 3",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "licensed under the isc license", "released under the isc licence",
    ),
    "lgpl": (
        "under the gnu lesser general public license", "licensed under the lgpl version 2 1", "distributed under the lgpl v3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "published under the gnu library general public license",
    ),
    "mit": (
        "released under the mit license", "licensed under the mit license", "distributed under the mit licence", "this software is available under the terms of the mit license", "this project is mit licensed", "mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "diese software steht unter der mit lizenz", "veröffentlicht unter der mit lizenz", "ce logiciel est distribué sous licence mit", "publicado bajo la licencia mit",
    ),
    "mpl": (
        "subject to the terms of the mozilla public license version 2 0", "licensed under the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "released under the mpl 2 0",
    ),
}

OTHER = (
    "the driver must carry a licence on the road", "he lost his licence for a year", "she asked for permission to leave the room", "the permission to enter was given by the keeper", "a warrant was issued by the court", "the copyright office opens at nine",
    "they took licence with the story", "poetic license is not a license to lie", "the table was reserved for all of them", "rights of way are reserved for walkers", "the public domain of the city is wide", "a general spoke to the public about version two of the plan",
    "the new version of the software runs on most machines", "free of charge for children under six", "a copy of the letter was found in the drawer", "the company sells software and services", "it was released in the spring of 1998", "the film was released under a different title",
    "she was licensed to practise medicine in two states", "the restaurant is fully licensed", "the seller gives no warranty on used cars", "the warranty lasts for two years", "all people have the same rights", "human rights are for all", "the source of the river lies in the hills",
    "binary numbers are written with two digits", "the conditions were met by both sides", "the list of names is long", "he gave notice to his landlord", "the notice on the door was old", "the author signed copies of the book", "the authors of the study found no difference", "a documentation of the trial was published",
    "the apache were a people of the south west", "the creative work of the group was common", "the commons debated the bill", "mozilla made a browser", "a gnu is an antelope of the plains", "berkeley is a town on the bay", "the students of mit built a bridge", "mit freundlichen grüßen", "mit der bahn nach berlin",
    "the eclipse was seen in the east", "general public opinion has changed", "the affair was in the public eye", "the library is open to the general public", "the foundation gave money for software", "attribution of the painting is disputed", "the international court met in may", "share and share alike said the boy",
    "der fahrer verlor seine fahrerlaubnis", "er hat die lizenz zum töten", "alle rechte und pflichten gehen über", "die genehmigung wurde erteilt", "das werk steht am fluss", "die öffentliche meinung ist geteilt", "il a perdu son permis de conduire", "tous les droits de douane", "le domaine est ouvert au public",
    "la licence de pêche coûte dix euros", "l autorisation a été donnée", "perdió la licencia de conducir", "todos los derechos humanos", "el dominio del río es largo", "la obra fue terminada en abril", "los autores hablaron del libro", "the use of the room is free", "you may use the side door", "the terms of the peace were hard",
    "the state of the art is reserved for few", "the club published its rules", "we provide the food as is usual", "no one is liable for the storm", "damages were paid to the owner", "the claim was denied", "a file was found on the desk", "software was written for the moon landing", "version 2 0 of the plan was better", "the law requires a written form",
)
